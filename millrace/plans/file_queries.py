"""Registered queries that write files into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import register
from millrace.sources import containers, readers, shards, sinks
from millrace.sources.shared import one_jvm, shared_path
from millrace.sources.tables import table
from millrace.streaming import folds

EVENT = "event_id long, event_type string, value double"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", "value")


@register("k1_json_lines", "select event_id, event_type, value from events")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "lines")
    sinks.write_json_lines(_events(spark, d), path)
    return readers.json_lines(spark, path, EVENT)


@register("s8_malformed_lines", "select event_id, event_type, value from events where event_id % 5 <> 0")
def malformed(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth line is cut off and dropped."""
    path = shared_path(spark, "broken")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    _events(spark, d).select(F.when(F.col("event_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return readers.json_lines(spark, path, EVENT)


@register("s4_errors_of_lines", "select count(*) n from events where event_id % 5 = 0")
def errors(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "errors")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    _events(spark, d).select(F.when(F.col("event_id") % 5 == 0, F.substring(line, 1, 9)).otherwise(line)).write.text(path)
    return readers.json_lines_with_errors(spark, path, EVENT)[1].agg(F.count("*").alias("n"))


@register("s5_tab_separated", "select event_id, event_type, case when event_id % 4 = 0 then 0 else event_id end n from events")
def tabs(spark: SparkSession, d: str) -> DataFrame:
    """A number that does not parse is 0."""
    path = shared_path(spark, "tabs")
    k = F.col("event_id")
    _events(spark, d).select(F.concat_ws("\t", k.cast("string"), "event_type", F.when(k % 4 == 0, "n/a").otherwise(k.cast("string")))).write.text(path)
    return readers.tab_separated(spark, path, {"event_id": "long", "event_type": "string", "n": "long"})


@register("k15_tsv_report", "select event_type, count(*)::varchar n from events group by 1")
def tsv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "tsv")
    sinks.write_csv(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), path, sep="\t")
    return spark.read.option("sep", "\t").option("header", "true").schema("event_type string, n string").csv(path)


@register("k12_by_time", "select event_type model, strftime(ts, '%d') d, count(*) n from events where event_type <> 'view' group by 1, 2")
def by_time(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "dump")
    e = table(spark, d, "events").withColumn("model", F.when(F.col("event_type") != "view", F.col("event_type"))).select("event_id", "model", "ts")
    sinks.write_by_time(e, path, "ts", finest="d")
    back = spark.read.schema("event_id long, model string, y string, m string, d string").json(f"{path}/data")
    return back.groupBy("model", "d").agg(F.count("*").alias("n"))


@register("k12_meta", "select event_type model, user_id session, count(*) n from events where event_type <> 'view' group by 1, 2")
def meta(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "meta")
    e = table(spark, d, "events").withColumn("model", F.when(F.col("event_type") != "view", F.col("event_type")))
    sinks.write_meta(e.select("event_id", "model", F.col("user_id").alias("session")), path, "session")
    return spark.read.schema("event_id long, model string, session long").json(f"{path}/meta").groupBy("model", "session").agg(F.count("*").alias("n"))


@register("s7_json_folder", "select n_regionkey::varchar parent, n_nationkey::varchar id, n_name from nation")
def folder(spark: SparkSession, d: str) -> DataFrame:
    """One file for each nation, keyed by its folder and name."""
    path = shared_path(spark, "tree")
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("p"), F.col("n_nationkey").cast("string").alias("k"), "n_name").collect()  # a fixed small table
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    import json

    for r in rows:
        at = fs.Path(f"{path}/{r.p}/{r.k}.json")
        out = at.getFileSystem(conf).create(at)
        out.write(bytearray(json.dumps({"n_name": r.n_name}).encode()))
        out.close()
    return readers.json_folder(spark, path, "n_name string")[0].select("parent", "id", "n_name")


@register("s10_session_import", "select 'c' || conv_id as session_id, 'm' || turn as message_id, 0 as position, 'text' as type, text from conversations")
def imported(spark: SparkSession, d: str) -> DataFrame:
    """Exported sessions, one to a file's line group, read back as parts."""
    path = shared_path(spark, "exports")
    c = table(spark, d, "conversations")
    sid, mid = F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("m"), F.col("turn").cast("string"))
    key = F.concat(sid, F.lit("/"), mid)
    sessions = c.select(sid.alias("id")).distinct().withColumn("title", F.lit("t"))
    messages = c.select(key.alias("id"), sid.alias("session_id"), "role", F.col("turn").alias("position"))
    parts = c.select(key.alias("message_id"), F.lit("p").alias("id"), F.lit(0).alias("position"), F.lit("text").alias("type"), "text")
    sinks.nested_sessions(sessions, messages, parts).repartition("id").select("body").write.text(path)
    back = readers.session_lines(spark, path)[2]
    return back.select("session_id", F.substring_index("message_id", "/", -1).alias("message_id"), "position", "type", "text")


@register("s12_lossy_text", "select doc_id, text || chr(65533) || 'x' as text from documents")
def lossy(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that are not UTF-8 become replacement characters."""
    broken = F.concat(F.col("text").cast("binary"), F.lit(b"\xff"), F.lit(b"x"))
    return table(spark, d, "documents").select("doc_id", readers.lossy(broken).alias("text"))


@register("k2_stream_sink", "select event_id, event_type, value from events")
def stream_sink(spark: SparkSession, d: str) -> DataFrame:
    """A stream appended to JSON lines from its checkpoint, and read back."""
    path = shared_path(spark, "sink")
    stream = folds.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "value")
    sinks.write_stream(stream, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(EVENT).json(f"{path}/data")


@register("o9_ordered_limit", "select doc_id from documents order by doc_id limit 25")
def ordered(spark: SparkSession, d: str) -> DataFrame:
    """Where the reference leaves the order of a limit open, keys decide."""
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@register(
    "s11_extracted",
    r"""select doc_id, ['docx', 'odt', 'txt', 'pdf'][doc_id % 4 + 1] kind, case when doc_id % 4 < 3 and (doc_id % 4 = 2 or doc_id % 50 > 0) then regexp_replace(coalesce(text, ''), '[\x01-\x08\x0B-\x1F]', '', 'g') end as text,
    case when doc_id % 4 = 3 then 'no reader for pdf' when doc_id % 4 <> 2 and doc_id % 50 = 0 then 'broken' end error from documents""",
)
def office_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of word processors, every fiftieth of them cut off, and read again."""
    kind = F.get(F.array(*map(F.lit, ("docx", "odt", "txt", "pdf"))), F.col("doc_id") % 4)
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x01-\x08\x0B-\x1F]", "")
    rows = table(spark, d, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), kind).alias("path"), text.alias("text"))
    cut = F.expr("substring(content, 1, cast(length(content) / 2 as int))")
    ends = (F.substring_index("path", ".", 1).cast("long") % 50 == 0) & ~F.col("path").endswith(".txt")
    files = containers.packed(rows).withColumn("content", F.when(ends, cut).otherwise(F.col("content")))
    got = containers.extracted(files)
    return got.select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), F.substring_index("path", ".", -1).alias("kind"), "text", "error")


@register("s3_database_scan", "select o_orderkey, o_custkey, o_totalprice from orders where o_totalprice > 150000 and o_custkey % 2 = 0")
def database_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders written to a database and read from it in ranges of their key, with the filter on the price left to the database.

    The database is the one that ``millrace.jdbc.url`` names; in one local JVM, Derby, which comes with Spark, stands for it,
    and on executors without a database that all of them reach, many small ones in the shared folder do.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    url = spark.conf.get("millrace.jdbc.url", None)
    if url is None:
        if not one_jvm(spark):
            path = shared_path(spark, "shards")
            shards.write(orders, path, "orders_scan")
            return shards.scan(spark, path, "orders_scan", orders.schema, "o_totalprice > 150000").where("o_custkey % 2 = 0")
        folder = shared_path(spark, "derby").removeprefix("file:").replace("//", "/")
        spark._jvm.System.setProperty("derby.stream.error.file", f"{folder}.log")
        url = f"jdbc:derby:{folder};create=true"
    orders.write.format("jdbc").option("url", url).option("dbtable", "orders_scan").option("isolationLevel", "READ_COMMITTED").mode("overwrite").save()
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).head()
    stored = readers.jdbc_table(spark, url, "orders_scan", "o_orderkey", (low or 0, (high or 0) + 1), 8)
    return stored.where("o_totalprice > 150000").where("o_custkey % 2 = 0")


@register("k3_stream_appended", "select event_type, count(*) n from events group by 1")
def stream_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same sink given twice from one checkpoint: what was appended is not appended again."""
    path = shared_path(spark, "sink")
    for _ in range(2):
        stream = folds.stream_of(spark, f"{d}/events.parquet").select("event_id", "event_type", "value")
        sinks.write_stream(stream, f"{path}/data", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(EVENT).json(f"{path}/data").groupBy("event_type").agg(F.count("*").alias("n"))
