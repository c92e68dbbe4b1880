"""Quality rules, line first: bad lines are removed, then documents that lost too much text are rejected.

DataFrame functions only; one narrow pass over the text, no shuffle, no Python on the executors.

Defined results: a null text counts as an empty one; an empty text has no words, fails the base rule and
is not kept; rows are judged one by one, so repeated rows give repeated results; other columns pass through; phrases
of page furniture count in lines of up to ``max_furniture_bytes`` bytes, as a longer line is a paragraph that quotes one.
A column of the input that has the name of a result column gives way to the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words, counted symbols, separators of navigation lines.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SEPARATOR = "|"
SQL_CHAR = {"\t": r"\t", "\n": r"\n", "\x0b": r"\u000B", "\f": r"\u000C", "\r": r"\r"}

# Phrases of page furniture, matched in lower-cased lines.
BOILERPLATE = (
    "all rights reserved",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here",
    "share this article",
    "follow us on",
    "skip to content",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the verdict on the whole text."""

    min_words: int = 20
    max_repeat_percent: int = 30
    max_symbol_percent: int = 10
    min_separators: int = 2
    max_fragment_words: int = 2
    min_shout_letters: int = 12
    max_stutter: int = 3
    max_furniture_bytes: int = 240
    min_kept_percent: int = 50


DEFAULT = LineRules()


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once however often ``body`` uses it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _without(text: str, chars: str) -> str:
    """SQL for ``text`` without ``chars``; plain replacements scan bytes and are far cheaper than a pattern."""
    for c in chars:
        text = f"replace({text}, '{SQL_CHAR.get(c, c)}', '')"
    return text


def split_words(text: str) -> str:
    """SQL for the array of words: white space becomes one kind of blank, and splitting at one character needs no pattern."""
    for c in BLANKS[1:]:
        text = f"replace({text}, '{SQL_CHAR[c]}', ' ')"
    return f"array_remove(split({text}, ' '), '')"


def repeated_words(words: str) -> str:
    """SQL for a struct: ``r`` counts the words lying in an 8-word window that occurs twice or more, first occurrences
    included, and ``s`` counts words equal to the word before.

    Windows are compared by a 64-bit hash that doubles its reach three times. Most texts have no repeated window
    and stop at the distinct count; the others sort (hash, position) pairs, keep neighbours with equal hashes and
    add up the covered positions, so a text of n words costs n log n.
    """
    cover = (
        "aggregate(p, struct(0L as c, -8 as z), (a, x) -> struct(a.c + least(8, x - a.z) as c, x as z), a -> a.c)"
    )
    twice = "transform(filter(s, (e, k) -> coalesce(get(s, k - 1).x = e.x, false) or coalesce(get(s, k + 1).x = e.x, false)), e -> e.i)"
    pairs = "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))"
    count = f"if(size(array_distinct(h)) = size(h), 0L, {_bind(pairs, 's', _bind(f'array_sort({twice})', 'p', cover))})"
    stutter = "if(size(array_distinct(h2)) = size(h2), 0L, cast(size(filter(h1, (x, i) -> coalesce(get(h1, i - 1) = x, false))) as bigint))"

    def reach(name: str, by: int) -> str:
        return f"zip_with(slice({name}, 1, size({name}) - {by}), slice({name}, {by + 1}, size({name}) - {by}), (a, b) -> xxhash64(a, b))"

    eight = _bind(reach("h2", 2), "h4", reach("h4", 4))
    both = _bind(reach("h1", 1), "h2", _bind(eight, "h", f"struct({count} as r, {stutter} as s)"))
    short = "struct(0L as r, 0L as s)"
    return f"if(size({words}) < 9, {short}, {_bind(f'transform({words}, x -> xxhash64(x))', 'h1', both)})"


def _count(text: str, chars: str) -> str:
    """SQL for how many characters of ``text`` are among ``chars``."""
    return f"length(regexp_replace({text}, '[^{chars}]+', ''))"


def line_failures(line: str, symbols: str, stutter: str, rules: LineRules = DEFAULT) -> str:
    """SQL for whether a line breaks a rule: symbols, navigation, shouting, fragments without punctuation, stutter, boilerplate.

    ``symbols`` and ``stutter`` are the counts of the whole text: where they are too small for any of its lines to
    break the rule, the costlier look at each line is left out.
    """
    blank, word = r"[\\x20\\x09-\\x0D]", r"[^\\x20\\x09-\\x0D]"
    last = f"right(rtrim('{''.join(SQL_CHAR.get(c, c) for c in BLANKS)}', {line}), 1)"
    furniture = " or ".join(f"contains(y, '{p}')" for p in BOILERPLATE)
    return (
        f"(({symbols} > 0 and ({_count(line, SYMBOLS)} * 100 > {rules.max_symbol_percent} * length({_without(line, BLANKS)})"
        f" or {_count(line, SEPARATOR)} >= {rules.min_separators}))"
        f" or (not {line} rlike '[a-z]' and length(regexp_replace({line}, '[^A-Z]+', '')) >= {rules.min_shout_letters})"
        f" or (not {last} rlike '[\\\\p{{P}}\\\\p{{S}}]' and not {line} rlike '^{blank}*({word}+{blank}+){{{rules.max_fragment_words}}}{word}')"
        f" or ({stutter} >= {rules.max_stutter} and {line} rlike '(?:^|{blank})({word}++)(?:{blank}++\\\\1(?!{word})){{{rules.max_stutter}}}')"
        f" or (octet_length({line}) <= {rules.max_furniture_bytes} and {_bind(f'lower({line})', 'y', f'({furniture})')}))"
    )


def _measured(text: str, rules: LineRules) -> Column:
    """A struct of a text's counts (``n``, ``r``, ``y``, ``d``) and its lines that pass (``c``)."""
    word = r"[^\\x20\\x09-\\x0D]"
    t = f"coalesce(`{text}`, '')"
    of_words = "struct(cast(size(w) as bigint) as n, q.r as r, q.s as s)"
    counts = _bind(split_words(t), "w", _bind(repeated_words("w"), "q", of_words))
    lines = _bind(
        f"filter(split({t}, '\\n'), x -> x rlike '{word}')",
        "l",
        "struct(w.n as n, w.r as r, y as y, cast(size(l) - size(array_distinct(l)) as bigint) as d,"
        f" array_join(filter(l, x -> not {line_failures('x', 'y', 'w.s', rules)}), '\\n') as c)",
    )
    return F.expr(_bind(counts, "w", _bind(f"cast({_count(t, SYMBOLS)} as bigint)", "y", lines)))


def _with_verdict(made: DataFrame, text: str, rules: LineRules) -> DataFrame:
    t = f"coalesce(`{text}`, '')"
    made = made.withColumns(
        {
            "n_words": F.col("__q.n"),
            "word_chars": F.expr(f"cast(length({_without(t, BLANKS)}) as bigint)"),
            "n_symbols": F.col("__q.y"),
            "n_dup_lines": F.col("__q.d"),
            "n_repeat_words": F.col("__q.r"),
            "cleaned": F.col("__q.c"),
            "cleaned_chars": F.expr(f"cast(length({_without('__q.c', BLANKS)}) as bigint)"),
        }
    )
    failed: Column = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    )
    made = made.withColumn("base_failed", failed)
    enough = F.col("cleaned_chars") * 100 >= F.col("word_chars") * rules.min_kept_percent
    return made.withColumn("kept", ~F.col("base_failed") & enough).drop("__q")


def judge(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """Add the counts, the cleaned text and the verdict to every row.

    ``kept`` is false where the base rules fail (too few words, too many repeated 8-word windows) or where the
    lines that pass hold less than ``min_kept_percent`` of the characters of all lines' words.
    """
    return _with_verdict(docs.withColumn("__q", _measured(text, rules)), text, rules)


def clean(docs: DataFrame, text: str = "text", rules: LineRules = DEFAULT) -> DataFrame:
    """The kept rows with their cleaned text, in the columns they came with; ``n_chars`` follows where it is there."""
    # Names of its own keep the input's columns apart from those of the verdict. The generator is there because a
    # filter is not pushed below it, which would measure every text twice.
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    measured = own.select("*", F.explode(F.array(_measured(names[text], rules))).alias("__q"))
    kept = _with_verdict(measured, names[text], rules).where("kept")
    cols = []
    for c, n in names.items():
        if c == text:
            cols.append(F.col("cleaned").alias(c))
        elif c == "n_chars":
            cols.append(F.length("cleaned").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(n).alias(c))
    return kept.select(*cols)
