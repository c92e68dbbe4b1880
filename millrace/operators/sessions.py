"""Sessions, messages and their parts: histories, contexts, permissions and text slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import wildcard_regex

# How many recently updated sessions are kept; texts that stand for parts of other kinds.
RECENT_SESSIONS = 50
PROTECTED_CHARS, LEAST_PRUNED = 40_000, 20_000
COMPACTED, SUBTASK = "What did we do so far?", "The following tool was executed by the user"
SKIPPED_FILES = ("text/plain", "application/x-directory")
PART = "array<struct<type: string, text: string>>"


def decision(permission: Column, pattern: Column, rules: list[tuple[str, str, str]], default: str = "ask") -> Column:
    """The action of the last rule (permission, pattern, action) whose wildcards both match."""
    out = F.lit(default)
    for p, q, action in rules:
        out = F.when(permission.rlike(wildcard_regex(p)) & pattern.rlike(wildcard_regex(q)), action).otherwise(out)
    return out


def decisions(requests: DataFrame, rules: DataFrame, default: str = "ask") -> DataFrame:
    """Requests (id, permission, pattern) with ``action`` by a table of rules (nr, permission, pattern, action).

    Both sides are reduced to their distinct texts before they meet, so the product is of vocabularies, not of rows.
    """
    regex = lambda c: F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"([\\.\[\]{}()+|^$])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    asked = requests.select("permission", "pattern").distinct()
    r = rules.select("nr", "action", regex(F.col("permission")).alias("p"), regex(F.col("pattern")).alias("q"))
    hit = F.expr("permission rlike p and pattern rlike q")
    best = asked.join(r, hit, "left").groupBy("permission", "pattern").agg(F.max_by("action", "nr").alias("action"))
    known = F.col("permission").eqNullSafe(F.col("p2")) & F.col("pattern").eqNullSafe(F.col("q2"))
    named = best.select(F.col("permission").alias("p2"), F.col("pattern").alias("q2"), "action")
    return requests.join(named, known, "left").select("id", "permission", "pattern", F.coalesce("action", F.lit(default)).alias("action"))


def session_record(row: dict[str, Column]) -> list[Column]:
    """The columns of a session record: a summary where any of its counts is there (the others 0), a share where its url is not empty."""
    counts = [row[c] for c in ("additions", "deletions", "files")]
    some = counts[0].isNotNull() | counts[1].isNotNull() | counts[2].isNotNull()
    summary = [F.when(some, F.coalesce(c, F.lit(0))).alias(f"summary_{n}") for c, n in zip(counts, ("additions", "deletions", "files"), strict=True)]
    return [*summary, F.when(F.coalesce(row["share_url"], F.lit("")) != "", row["share_url"]).alias("share_url")]


def since_compaction(messages: DataFrame) -> DataFrame:
    """Messages (session, id, role, parent, summary, finish, error, compaction) from the last completed compaction on.

    A compaction is a user message that asks for one; it is completed by a newer assistant message under it that
    is a summary, has finished and has no error. A session without one keeps all its messages.
    """
    done = messages.where("role = 'assistant' and summary and finish and not error and id > parent").select("session", F.col("parent").alias("id")).distinct()
    marks = messages.where("role = 'user' and compaction").select("session", "id").join(done, ["session", "id"], "left_semi")
    first = marks.groupBy("session").agg(F.max("id").alias("__from"))
    return messages.join(first, "session", "left").where("__from is null or id >= __from").drop("__from")


def to_prune(parts: DataFrame, protect: int = PROTECTED_CHARS, least: int = LEAST_PRUNED) -> DataFrame:
    """Parts (session, id, tokens) that lie behind the newest ``protect`` tokens, where they hold more than ``least`` in all.

    The part that crosses the border goes too.
    """
    newest = Window.partitionBy("session").orderBy(F.desc("id"))
    behind = parts.withColumn("__sum", F.sum("tokens").over(newest)).where(F.col("__sum") > protect)
    enough = behind.groupBy("session").agg(F.sum("tokens").alias("__all")).where(F.col("__all") > least)
    return behind.join(enough, "session", "left_semi").drop("__sum")


def trimmed(sessions: DataFrame, limit: int, cutoff, asking: DataFrame, recent: int = RECENT_SESSIONS) -> DataFrame:
    """The sessions (id, parent, archived, updated) of a list: the first roots by id, further ones updated after ``cutoff``
    (the ``recent`` newest), and children of these, children with a request (asking: id) and children updated after it.
    """
    live = sessions.where("id is not null and not coalesce(archived, false)")
    roots = live.where("parent is null")
    base = roots.orderBy("id").limit(limit)
    rest = roots.join(base.select("id"), "id", "left_anti").where(F.col("updated") > cutoff)
    kept = base.unionByName(rest.orderBy(F.desc("updated"), "id").limit(recent))
    wanted = kept.select(F.col("id").alias("parent"), F.lit(True).alias("__kept"))
    children = live.where("parent is not null").join(wanted, "parent", "left").join(asking.select("id", F.lit(True).alias("__asks")).distinct(), "id", "left")
    children = children.where(F.coalesce("__kept", "__asks", F.col("updated") > cutoff)).drop("__kept", "__asks")
    return kept.unionByName(children.select(kept.columns))


def context_breakdown(chars: dict[str, Column], total: Column) -> Column:
    """struct(system, user, assistant, tool, other) of tokens: characters / 4 rounded up, scaled down where they exceed ``total``; null without a total."""
    names = ("system", "user", "assistant", "tool")
    tokens = F.struct(*[F.ceil(F.coalesce(chars[n], F.lit(0)) / 4).cast("long").alias(n) for n in names])

    def built(t: Column) -> Column:
        summed = t["system"] + t["user"] + t["assistant"] + t["tool"]
        share = total / summed
        scaled = [F.when(summed <= total, t[n]).otherwise(F.floor(t[n] * share)).cast("long") for n in names]
        other = F.greatest(F.lit(0), total - (scaled[0] + scaled[1] + scaled[2] + scaled[3]))
        return F.struct(*[c.alias(n) for c, n in zip(scaled, names, strict=True)], other.cast("long").alias("other"))

    return F.when(total > 0, F.transform(F.array(tokens), built)[0])


def reverted(parts: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Parts (session, message, part) that stay after a revert to (session, at_message, at_part): what comes before.

    Without a part the whole message goes; a session without a boundary stays whole.
    """
    both = parts.join(boundaries, "session", "left")
    before = (F.col("message") < F.col("at_message")) | ((F.col("message") == F.col("at_message")) & (F.col("part") < F.col("at_part")))
    return both.where(F.col("at_message").isNull() | F.coalesce(before, F.lit(False))).drop("at_message", "at_part")


def for_model(parts: DataFrame, strip_media: bool = False) -> DataFrame:
    """User parts (session, message, part, type, text, ignored, mime, filename) as (.., kind, content) that a model is shown.

    Ignored texts and files that were turned into texts are left out; a message without any part is not there.
    """
    kind, mime = F.col("type"), F.coalesce("mime", F.lit(""))
    media = mime.startswith("image/") | (mime == "application/pdf")
    file = (kind == "file") & ~mime.isin(*SKIPPED_FILES)
    note = F.concat(F.lit("[Attached "), mime, F.lit(": "), F.coalesce("filename", F.lit("file")), F.lit("]"))
    content = (
        F.when((kind == "text") & ~F.coalesce("ignored", F.lit(False)), F.col("text"))
        .when(file & media & F.lit(strip_media), note)
        .when(file, F.coalesce("filename", F.lit("file")))
        .when(kind == "compaction", COMPACTED)
        .when(kind == "subtask", SUBTASK)
    )
    shown = F.when(file & ~(media & F.lit(strip_media)), "file").otherwise("text")
    return parts.select("session", "message", "part", shown.alias("kind"), content.alias("content")).where("content is not null")


def _parts_of(content: Column) -> Column:
    return F.from_json(content, PART)


def text_slots(messages: DataFrame) -> DataFrame:
    """(session, message, part, text) of messages whose ``content`` is JSON: a string (part is null) or an array of parts.

    Of parts, those of type ``text`` with a text are slots.
    """
    plain = messages.where(F.substring(F.trim("content"), 1, 1) == '"')
    strings = plain.select("session", "message", F.lit(None).cast("int").alias("part"), F.get_json_object(F.concat(F.lit('{"t":'), "content", F.lit("}")), "$.t").alias("text"))
    arrays = messages.where(F.substring(F.trim("content"), 1, 1) == "[").select("session", "message", F.posexplode(_parts_of(F.col("content"))).alias("part", "p"))
    return strings.unionByName(arrays.where("p.type = 'text' and p.text is not null").select("session", "message", "part", F.col("p.text").alias("text")))


def with_text_slots(messages: DataFrame, cleaned: DataFrame) -> DataFrame:
    """The messages with the texts of ``cleaned`` (session, message, part, text) written back into their slots.

    The slots of one message are gathered, as its content is one value. Parts keep their type and text; a message
    without cleaned slots stays as it is.
    """
    slots = cleaned.groupBy("session", "message").agg(F.collect_list(F.struct("part", "text")).alias("__s"))
    both = messages.join(slots, ["session", "message"], "left")
    whole = F.get(F.filter("__s", lambda s: s["part"].isNull()), F.lit(0))["text"]

    def filled(p: Column, i: Column) -> Column:
        own = F.filter("__s", lambda s: s["part"] == i)
        return F.struct(p["type"].alias("type"), F.when(F.size(own) > 0, own[0]["text"]).otherwise(p["text"]).alias("text"))

    as_string = F.regexp_extract(F.to_json(F.struct(whole.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    content = F.when(F.col("__s").isNull(), F.col("content")).when(whole.isNotNull(), as_string).otherwise(F.to_json(F.transform(_parts_of(F.col("content")), filled)))
    return both.withColumn("content", content).drop("__s")


def anonymized(messages: DataFrame, profile: str = "max", patterns=None) -> tuple[DataFrame, DataFrame]:
    """The messages with all their text slots treated, and the tokens (session, token, value) to restore answers with."""
    from millrace.operators import privacy

    slots = text_slots(messages).withColumn("__k", F.struct("session", "message", "part"))
    done = privacy.anonymize(slots, profile, patterns or privacy.LEGAL, "__k")
    cleaned = done.select("__k.*", "text")
    tokens = done.select(F.col("__k.session").alias("session"), F.explode("token_map").alias("token", "value")).distinct()
    return with_text_slots(messages, cleaned), tokens
