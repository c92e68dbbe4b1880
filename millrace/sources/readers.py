"""Sources: tolerant JSON lines, tab-separated rows, JSON folders keyed by path, session exports, texts and files by glob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that parse; others are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_with_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows that parse, and the texts of those that do not."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    valid = F.expr("try_parse_json(value)").isNotNull()
    return parsed.where(valid).select("r.*"), parsed.where(~valid).select(F.col("value").alias("bad"))


def tab_separated(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of named columns; a number that does not parse is 0."""
    raw = spark.read.option("sep", "\t").schema(", ".join(f"{c} string" for c in columns)).csv(path)
    return raw.select(*[(F.col(c) if t == "string" else F.coalesce(F.col(c).try_cast(t), F.lit(0).cast(t))).alias(c) for c, t in columns.items()])


def json_folder(spark: SparkSession, path: str, schema: str, parent: str = "parent", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """One JSON object per file below ``path/<parent>/<id>.json``: rows with both keys, and the paths that do not parse."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    at = F.col("_metadata.file_path")
    named = files.select(
        "value", at.alias("path"), F.regexp_extract(at, r"([^/]+)/[^/]+\.json$", 1).alias(parent), F.regexp_extract(at, r"([^/]+)\.json$", 1).alias(key)
    )
    valid = F.expr("try_parse_json(value)").isNotNull()
    good = named.where(valid).select(parent, key, F.from_json("value", schema).alias("r")).select(parent, key, "r.*")
    return good, named.where(~valid).select("path")


def session_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An export ``{info, messages: [{info, parts}]}`` as sessions, messages and parts, with positions."""
    return _sessions(spark.read.option("wholetext", "true").text(path))


def session_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of files that hold an export on each line."""
    return _sessions(spark.read.text(path))


def _sessions(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    info = "struct<id: string, title: string>"
    message = "struct<info: struct<id: string, role: string>, parts: array<struct<id: string, type: string, text: string>>>"
    s = raw.select(F.from_json("value", f"struct<info: {info}, messages: array<{message}>>").alias("s")).select("s.*")
    m = s.select(F.col("info.id").alias("session_id"), F.posexplode("messages").alias("position", "m"))
    messages = m.select("session_id", F.col("m.info.id").alias("id"), F.col("m.info.role").alias("role"), "position")
    parts = m.select("session_id", F.col("m.info.id").alias("message_id"), F.posexplode("m.parts").alias("position", "p"))
    return s.select("info.*"), messages, parts.select("session_id", "message_id", "position", "p.*")


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of all files; bytes that are not UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", lossy(F.col("content")).alias("text"))


def lossy(content: Column) -> Column:
    """Bytes as text; those that are not UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def listing(spark: SparkSession, path: str, glob: str = "*", after: str | None = None, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) in path order, from a key on and up to a limit; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    files = files.select("path", "length", "modificationTime")
    files = files.where(F.col("path") > after) if after else files
    files = files.orderBy("path")
    return files.limit(limit) if limit is not None else files


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A table of a database; filters and columns are pushed to it. With a numeric key and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def unignored(paths: DataFrame, ignore: list[str], glob: str | None = None) -> DataFrame:
    """Paths that no ignore rule takes: rules are globs, a later one counts, ``!`` takes back, a final slash names a folder.

    Paths are relative; those below ``.git`` are never listed.
    """
    from millrace.functions.text import glob_regex

    out = F.lit(False)
    for rule in [r for r in ignore if r.strip() and not r.startswith("#")]:
        keep, body = rule.startswith("!"), rule.lstrip("!").rstrip("/")
        anchored = "/" in body
        regex = glob_regex(body.lstrip("/") if anchored else f"**/{body}")[:-1] + "(?:/.*)?$"
        out = F.when(F.col("path").rlike(regex), not keep).otherwise(out)
    kept = paths.where(~out & ~F.col("path").rlike(r"(^|/)\.git(/|$)"))
    return kept.where(F.col("path").rlike(glob_regex(glob if "/" in glob else f"**/{glob}"))) if glob else kept
