"""Readers of raw payloads. Each gives an empty table of its schema where a dataset is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.sources import schemas
from basalt.sources.frames import COMPRESSED, FIELDS_AT
from basalt.sources.store import exists


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def path_part(name: str, pattern: str = r"\d{4}-\d{2}-\d{2}"):
    """The value of ``name=value`` in the file's path."""
    return F.nullif(F.regexp_extract(F.col("file"), f"{name}=({pattern})", 1), F.lit(""))


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def _payloads(spark: SparkSession):
    """A reader of payload files, each one payload, at any depth below a folder or by a pattern; sidecars are left out."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{gz,frame}")


def envelope(spark: SparkSession, pattern: str, fields: str) -> DataFrame:
    """Rows of ``{"results": [...]}`` pages with the file's path; pages without results have none."""
    if not exists(spark, pattern):
        return empty(spark, _struct(fields).add("file", "string"))
    pages = _payloads(spark).schema(T.StructType().add("results", T.ArrayType(_struct(fields)))).json(pattern)
    return pages.select(F.explode("results").alias("r"), F.col("_metadata.file_path").alias("file")).select("r.*", "file")


def ticker_events(spark: SparkSession, pattern: str) -> DataFrame:
    """composite_figi, symbol, event_date of ticker changes."""
    if not exists(spark, pattern):
        return empty(spark, "composite_figi string, symbol string, event_date date")
    pages = _payloads(spark).schema(schemas.TICKER_EVENTS).json(pattern)
    rows = pages.select(F.nullif("results.composite_figi", F.lit("")).alias("composite_figi"), F.explode("results.events").alias("e"))
    rows = rows.select("composite_figi", F.col("e.ticker_change.ticker").alias("symbol"), F.to_date("e.date").alias("event_date"))
    return rows.filter("composite_figi is not null and symbol is not null").distinct()


def holidays(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of top-level arrays with the file's path."""
    if not exists(spark, pattern):
        return empty(spark, _struct(schemas.HOLIDAYS).add("file", "string"))
    return _payloads(spark).schema(schemas.HOLIDAYS).json(pattern).select("*", F.col("_metadata.file_path").alias("file"))


def minute_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """Minute bars of daily CSV files with a header; times are nanoseconds since 1970."""
    if not exists(spark, pattern):
        return empty(spark, schemas.MINUTES)
    rows = spark.read.schema(schemas.MINUTE_CSV).option("header", True).csv(pattern).withColumn("file", F.col("_metadata.file_path"))
    return rows.select(path_part("date").cast("date").alias("market_date"), F.col("ticker").alias("symbol"), F.timestamp_seconds(F.expr("window_start div 1000000000")).alias("window_start_utc"), "open", "high", "low", "close", "volume", "transactions").filter("market_date is not null")


def minutes(spark: SparkSession, root: str) -> DataFrame:
    """Minute facts, one partition for each date, so a filter on the date prunes directories."""
    if not exists(spark, f"{root}/market_date=*"):
        return empty(spark, schemas.MINUTES)
    return spark.read.schema(schemas.MINUTES).parquet(root)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """The index of landed files, from their sidecars."""
    if not exists(spark, root):
        return empty(spark, schemas.MANIFEST)
    return spark.read.schema(schemas.MANIFEST).option("pathGlobFilter", "*.meta.json").option("recursiveFileLookup", True).option("multiLine", True).json(root)


def frame_records(spark: SparkSession, pattern: str, width: int) -> DataFrame:
    """c1..c<width> (trimmed), field8 and file of the records of framed responses.

    A frame is a header of 21 characters and a body parted by SOH; its seventh
    field is JSON with an array of arrays.
    """
    names = [f"c{i}" for i in range(1, width + 1)]
    if not exists(spark, pattern):
        return empty(spark, ", ".join(f"{n} string" for n in [*names, "field8", "file"]))
    body = F.split(F.substring("value", 22, 2**31 - 1), "\u0001", -1)
    pages = _payloads(spark).text(pattern, wholetext=True).select(body.alias("b"), F.col("_metadata.file_path").alias("file"))
    pages = pages.select(F.get("b", F.lit(6)).alias("payload"), F.get("b", F.lit(7)).alias("field8"), "file").filter(F.trim("payload") != "")
    rows = pages.select(F.explode(F.from_json("payload", "record array<array<string>>")["record"]).alias("r"), "field8", "file")
    return rows.select(*[F.trim(F.get("r", F.lit(i))).alias(n) for i, n in enumerate(names)], "field8", "file")


def frame_checks(spark: SparkSession, pattern: str) -> DataFrame:
    """file, method, problem of framed responses: null, or what the parser of single files would refuse."""
    if not exists(spark, pattern):
        return empty(spark, "file string, method string, problem string")
    head, body = F.split(F.substring("value", 1, 21), "\u0001", -1), F.regexp_replace(F.substring("value", 22, 2**31 - 1), r"\n\z", "")
    f = spark.read.text(pattern, wholetext=True).select(head.alias("h"), body.alias("body"), F.col("_metadata.file_path").alias("file"))
    f = f.withColumn("method", F.get(F.split("body", "\u0001", -1), F.lit(2)))
    length = F.expr("try_cast(h[2] as int)")
    problem = F.when((F.size("h") != 3) | length.isNull(), "header").when(~F.get("h", F.lit(1)).isin(*COMPRESSED) & (F.char_length("body") != length), "length").when(~F.coalesce(F.col("method").isin(*FIELDS_AT), F.lit(False)), "method")
    return f.select("file", "method", problem.alias("problem"))


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants."""
    return spark.createDataFrame(rows, schema)


def date_range(spark: SparkSession, first, last) -> DataFrame:
    """market_date of every day from ``first`` to ``last``."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 day"))).alias("market_date"))


def catalog(spark: SparkSession) -> DataFrame:
    """kind, name of the session's tables, views and temporary functions."""
    named = [("view" if t.isTemporary else "table", t.name) for t in spark.catalog.listTables()]
    named += [("function", f.name) for f in spark.catalog.listFunctions() if f.isTemporary and not _built_in(spark, f.name)]
    return spark.createDataFrame(sorted(named), "kind string, name string")


def _built_in(spark: SparkSession, name: str) -> bool:
    """Whether the function comes with Spark."""
    registry = spark._jvm.org.apache.spark.sql.catalyst.analysis
    known = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    return registry.FunctionRegistry.builtin().functionExists(known) or registry.TableFunctionRegistry.builtin().functionExists(known)
