"""Landing of raw payloads and writing of facts, in any store that Spark reads.

Payload files are truth and are written once, by rename; their index is
rebuilt from the sidecars. Facts are written as whole generations: a new
directory is filled, then a pointer file is replaced, so readers keep the old
generation until the new one is complete.
"""

from __future__ import annotations

import datetime as dt
import gzip
import hashlib
import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basalt.functions.columns import first_by
from basalt.sources import store

QUARANTINE_KEY = ["dataset", "market_scope", "symbol", "market_date"]


def land(spark: SparkSession, root: str, relative: str, payload: bytes, *, compress: bool = True, **meta) -> dict:
    """Write a payload and its sidecar; the sidecar's fields are returned."""
    data = gzip.compress(payload, mtime=0) if compress else payload
    path = relative + (".gz" if compress else "")
    store.write(spark, f"{root}/{path}", data)
    manifest = {"fetch_id": str(uuid.uuid4()), "http_status": 200, "fetched_at": dt.datetime.now(dt.UTC).isoformat()} | meta
    manifest |= {"file_path": path, "file_bytes": len(data), "content_sha256": hashlib.sha256(payload).hexdigest()}
    store.write(spark, f"{root}/{path}.meta.json", json.dumps(manifest).encode())
    return manifest


def clear(spark: SparkSession, root: str, prefix: str) -> int:
    """Delete landed files whose relative path begins with ``prefix``; how many payloads went."""
    gone = [f for f in store.files(spark, root) if f.startswith(prefix)]
    for f in gone:
        store.delete(spark, f"{root}/{f}")
    return sum(not f.endswith(".meta.json") for f in gone)


def write_generation(tables: dict[str, DataFrame], root: str) -> str:
    """Write all tables as a new generation and make it the current one."""
    name = f"{dt.datetime.now(dt.UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    for table, df in tables.items():
        df.write.parquet(f"{root}/{name}/{table}")
    store.write(next(iter(tables.values())).sparkSession, f"{root}/CURRENT", name.encode())
    return name


def current_generation(spark: SparkSession, root: str) -> str | None:
    name = store.read(spark, f"{root}/CURRENT")
    return name.decode().strip() if name else None


def read_generation(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current_generation(spark, root)}/{table}")


def drop_generations(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the latest generations; the current one always stays."""
    names, current = store.folders(spark, root), current_generation(spark, root)
    for n in names[:-keep] if keep else names:
        if n != current:
            store.delete(spark, f"{root}/{n}")


def quarantine(*parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows that could not be resolved, one for each key: those that are there stay, of new ones the first by reason and sample."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = first_by(rows, QUARANTINE_KEY, F.asc_nulls_last("reason"), F.asc_nulls_last("sample"))
    return rows if existing is None else existing.unionByName(rows.join(existing, QUARANTINE_KEY, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows and those of ``existing`` whose key they have not."""
    return new.unionByName(existing.join(new, key, "left_anti"))


def write_minutes(rows: DataFrame, root: str, force: bool = True) -> int:
    """Write minute bars by date, sorted by symbol and time; how many rows were written.

    Without ``force``, dates that are there already are left alone. The dates
    are written beside their place and counted; if a row is missing, what was
    written goes and ValueError is raised, and the old dates stay as they were.
    """
    spark = rows.sparkSession
    there = [f.partition("=")[2] for f in store.folders(spark, root) if f.startswith("market_date=")]
    if there and not force:
        rows = rows.filter(~F.col("market_date").cast("string").isin(*there))
    counted, beside = Observation(), f"{root}/_staged-{uuid.uuid4().hex}"
    try:
        parts = rows.observe(counted, F.count(F.lit(1)).alias("n")).repartition("market_date").sortWithinPartitions("symbol", "window_start_utc")
        parts.write.partitionBy("market_date").parquet(beside)
        dates = store.folders(spark, beside)
        found = spark.read.schema(rows.schema).parquet(beside).count() if dates else 0
        expected = counted.get["n"] if dates else rows.count()
        if found != expected:
            raise ValueError(f"{found} rows were written, not {expected}")
        for d in dates:
            store.delete(spark, f"{root}/{d}")
            store.move(spark, f"{beside}/{d}", f"{root}/{d}")
    finally:
        store.delete(spark, beside)
    return found
