"""Event streams as text, metric logs, share logs and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where paths of changed files lead, the first prefix that fits: an example, as every repository has areas of its own.
AREAS = (
    ("core/cmd/", "tui"),
    ("core/", "core"),
    ("desktop/native/", "tauri"),
    ("desktop/", "app"),
    ("app/", "app"),
    ("sdk/", "sdk"),
    ("plugin/", "plugin"),
    ("extensions/", "extensions"),
    ("github/", "github"),
)
# Fixed value: kinds of commits that are not listed.
UNLISTED = r"(?i)^(ignore|test|chore|ci|release):"
METRIC = "_metric:"
RETRY = 1000


def sse_frames(body: Column) -> Column:
    """The frames of an event stream: array of struct(seq, raw, json, id, retry), without one that is not ended by a blank line.

    ``raw`` joins a frame's data lines and ``json`` says whether it parses; ``id`` and ``retry`` are the last ones given so far.
    A frame without data only carries these on.
    """
    text = F.regexp_replace(body, r"\r\n?", "\n")
    ended = F.split(text, "\n\n")
    frames = F.slice(ended, F.lit(1), F.greatest(F.size(ended) - 1, F.lit(0)))
    item = "array<struct<seq: int, raw: string, json: boolean, id: string, retry: int>>"

    def values(lines: Column, name: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(name + ":"))
        return F.transform(own, lambda x: F.regexp_replace(x, rf"^{name}:\s*", ""))

    def step(a: Column, frame: Column) -> Column:
        lines = F.split(frame, "\n")
        data, ids = values(lines, "data"), values(lines, "id")
        retries = F.filter(F.transform(values(lines, "retry"), lambda x: F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("int")), lambda n: n.isNotNull())
        last = F.when(F.size(ids) > 0, F.element_at(ids, -1)).otherwise(a["id"])
        retry = F.when(F.size(retries) > 0, F.element_at(retries, -1)).otherwise(a["retry"])
        raw = F.array_join(data, "\n")
        valid = F.call_function("try_parse_json", raw).isNotNull()
        made = F.struct(F.size(a["out"]).alias("seq"), raw.alias("raw"), valid.alias("json"), F.when(last != "", last).alias("id"), retry.alias("retry"))
        out = F.when(F.size(data) > 0, F.concat(a["out"], F.array(made))).otherwise(a["out"])
        return F.struct(out.alias("out"), last.alias("id"), retry.alias("retry"))

    first = F.struct(F.array().cast(item).alias("out"), F.lit("").alias("id"), F.lit(RETRY).alias("retry"))
    return F.aggregate(frames, first, step, lambda a: a["out"])


def sse_usage(chunks: DataFrame, key: str = "stream", order: str = "seq", body: str = "chunk", path: str = "usage", separator: str = "\n\n") -> DataFrame:
    """(key, usage): the last usage record of each stream, which came in chunks that may end anywhere.

    A stream's chunks are joined, as a record may be parted by them; what follows the last separator is not complete.
    """
    joined = chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, body))), lambda x: x[body]), "").alias("__b"))
    parts = F.split("__b", separator)
    complete = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    data = F.transform(F.filter(F.transform(complete, F.trim), lambda x: x.startswith("data: ")), lambda x: F.get_json_object(F.substring(x, 7, F.length(x)), f"$.{path}"))
    return joined.select(key, F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(data, lambda x: x.isNotNull())), -1).alias("usage"))


def metric_rows(lines: DataFrame) -> DataFrame:
    """(request, seq, event_type, data): for requests with log lines (request, seq, message), an error row for each metric line
    that has an error code and a final row, each with the values merged so far as a map; a later value of a key wins.

    ``base`` (a map) holds what is known of the request itself. A request's lines are gathered: they are one log.
    """
    parsed = F.from_json(F.substring("message", len(METRIC) + 1, 1 << 30), "map<string,string>")
    of = lines.withColumn("__m", F.when(F.col("message").startswith(METRIC), parsed))
    per = of.groupBy("request").agg(F.first("base", ignorenulls=True).alias("base"), F.array_sort(F.collect_list(F.when(F.col("__m").isNotNull(), F.struct("seq", F.map_entries("__m").alias("m"))))).alias("ms"))
    row = "array<struct<event_type: string, data: map<string, string>>>"

    def merged(a: Column, entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        kept = F.map_filter(a, lambda k, _: ~F.array_contains(keys, k))
        return F.map_concat(kept, F.map_from_entries(entries))

    def step(a: Column, line: Column) -> Column:
        def told(now: Column) -> Column:
            error = F.exists(line["m"], lambda e: e["key"] == "llm.error.code")
            made = F.struct(F.lit("llm.error").alias("event_type"), now.alias("data"))
            return F.struct(now.alias("data"), F.when(error, F.concat(a["rows"], F.array(made))).otherwise(a["rows"]).alias("rows"))

        return F.transform(F.array(merged(a["data"], line["m"])), told)[0]

    first = F.struct(F.coalesce("base", F.create_map().cast("map<string,string>")).alias("data"), F.array().cast(row).alias("rows"))
    done = F.aggregate("ms", first, step, lambda a: F.concat(a["rows"], F.array(F.struct(F.lit("completions").alias("event_type"), a["data"].alias("data")))))
    return per.select("request", F.posexplode(done).alias("seq", "r")).select("request", "seq", "r.event_type", "r.data")


def compacted(base: DataFrame, events: DataFrame, keys: list[str], seq: str) -> tuple[DataFrame, DataFrame]:
    """A share's snapshot after its newer events: the last value of each key, and the last event's number by share.

    ``base`` and ``events`` have the keys (the share first), ``value`` and the number of the event that set it; events
    up to the base's last one are in it already.
    """
    share = keys[0]
    marks = base.groupBy(share).agg(F.max(seq).alias("__at"))
    newer = events.join(marks, share, "left").where(F.col("__at").isNull() | (F.col(seq) > F.col("__at"))).drop("__at")
    both = base.unionByName(newer)
    # One row for each key and task is shuffled, however many events a share has.
    data = both.groupBy(*keys).agg(F.max_by("value", seq).alias("value"), F.max(seq).alias(seq))
    return data, data.groupBy(share).agg(F.max(seq).alias("event"))


def published(writes: DataFrame, prefixes: list[str]) -> DataFrame:
    """(key, value): the last value written under each key that starts with an allowed prefix."""
    allowed = F.lit(False)
    for p in prefixes:
        allowed = allowed | F.col("key").startswith(p)
    return writes.where(allowed).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def listed(store: DataFrame, prefix: str, after: str | None = None, before: str | None = None, limit: int | None = None) -> DataFrame:
    """The keys under a prefix in their order, between two of them if told, up to a limit."""
    out = store.where(F.col("key").startswith(prefix)).select("key")
    out = out.where(F.col("key") > after) if after is not None else out
    out = out.where(F.col("key") < before) if before is not None else out
    out = out.orderBy("key")
    return out.limit(limit) if limit is not None else out


def area(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, name in reversed(AREAS):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def changes(log: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """(nr, sha, author, message, areas): the commits of a log (nr, sha) that are known (sha, login, message) and touch an area by their files (sha, path)."""
    first = F.substring_index("message", "\n", 1)
    known = commits.select("sha", F.col("login").alias("author"), first.alias("message")).where(~F.col("message").rlike(UNLISTED))
    areas = files.select("sha", area(F.col("path")).alias("area")).where("area is not null").groupBy("sha").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    return log.join(known, "sha").join(areas, "sha").select("nr", F.substring("sha", 1, 7).alias("sha"), "author", "message", "areas")


def without_reverts(commits: DataFrame) -> DataFrame:
    """Commits (nr, message) without those that a revert, before or after them in the log, cancels; the revert goes too.

    A message and its revert toggle each other: walking the log, one cancels the other if that stands, else it stands
    itself, and of several with one message the last one stands in the place of the first. Rows are folded for each title that has a revert only.
    """
    title = F.regexp_extract("message", r'^Revert "(.+)"$', 1)
    named = commits.withColumn("__is", title != "").withColumn("__t", F.when(title != "", title).otherwise(F.col("message")))
    both = named.groupBy("__t").agg(F.max("__is").alias("__r"), F.array_sort(F.collect_list(F.struct("nr", "__is"))).alias("__l"))

    def step(a: Column, x: Column) -> Column:
        other = F.when(x["__is"], a["plain"]).otherwise(a["revert"])
        mine = F.when(other.isNotNull(), F.when(x["__is"], a["revert"]).otherwise(a["plain"])).otherwise(x["nr"])
        left = F.lit(None).cast("long")
        plain = F.when(x["__is"], F.when(other.isNotNull(), left).otherwise(a["plain"])).otherwise(mine)
        revert = F.when(x["__is"], mine).otherwise(F.when(other.isNotNull(), left).otherwise(a["revert"]))
        return F.struct(plain.cast("long").alias("plain"), revert.cast("long").alias("revert"))

    none = F.struct(F.lit(None).cast("long").alias("plain"), F.lit(None).cast("long").alias("revert"))
    stand = both.select(F.aggregate("__l", none, step).alias("s"))
    kept = stand.select(F.explode(F.array("s.plain", "s.revert")).alias("nr")).where("nr is not null")
    return commits.join(kept, "nr", "left_semi")


def working_tree(modified: DataFrame, untracked: DataFrame, deleted: DataFrame) -> DataFrame:
    """(path, added, removed, status) of modified (path, added, removed as texts), untracked (path, text) and deleted (path) files.

    ``-`` counts as 0; an untracked file's lines all count as added; a path may stand there twice.
    """
    number = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c)
    m = modified.select("path", number("added"), number("removed"), F.lit("modified").alias("status"))
    u = untracked.select("path", F.size(F.split("text", "\n")).alias("added"), F.lit(0).alias("removed"), F.lit("added").alias("status"))
    d = deleted.select("path", F.lit(0).alias("added"), F.lit(0).alias("removed"), F.lit("deleted").alias("status"))
    return m.unionByName(u).unionByName(d)


def numstat(lines: DataFrame, statuses: DataFrame) -> DataFrame:
    """(path, added, removed, status) of tab-separated lines; ``-`` of binary files is 0, an unknown status is ``modified``."""
    parts = F.split("line", "\t")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.lit(0))
    rows = lines.select(F.get(parts, F.lit(2)).alias("path"), number(0).alias("added"), number(1).alias("removed")).where("path is not null")
    return rows.join(statuses, "path", "left").withColumn("status", F.coalesce("status", F.lit("modified")))


def tree_rows(paths: DataFrame, most: int = 100) -> DataFrame:
    """(nr, depth, name, is_dir): the first ``most`` paths as an indented listing; a folder's folders stand before its files, both by name.

    At most ``most`` paths are ordered.
    """
    some = paths.select("path").distinct().orderBy("path").limit(most).withColumn("p", F.split("path", "/"))
    dirs = some.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.slice("p", F.lit(1), i))).alias("p")).distinct().withColumn("is_dir", F.lit(True))
    both = dirs.unionByName(some.select("p", F.lit(False).alias("is_dir")))
    # Within its folder a folder's key sorts before a file's.
    key = F.transform("p", lambda x, i: F.struct((~F.col("is_dir") & (i == F.size("p") - 1)).alias("f"), x.alias("x")))
    nr = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")) - 1
    name = F.when(F.size("p") == 0, "").otherwise(F.element_at(F.concat(F.array(F.lit("")), "p"), -1))
    return both.withColumn("key", key).select(nr.alias("nr"), F.size("p").alias("depth"), name.alias("name"), "is_dir")


def breadth_first(paths: DataFrame, limit: int = 50) -> DataFrame:
    """(nr, path, depth, hidden): the first ``limit`` entries of a tree, level by level; ``hidden`` counts those that are not shown."""
    p = F.split("path", "/")
    every = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))).alias("path")).distinct()
    every = every.withColumn("depth", F.size(F.split("path", "/")))
    total = every.agg(F.count("*").alias("__n"))
    shown = every.orderBy("depth", "path").limit(limit).withColumn("nr", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("depth", "path")) - 1)
    return shown.join(F.broadcast(total)).select("nr", "path", "depth", F.greatest(F.col("__n") - limit, F.lit(0)).alias("hidden"))  # one row
