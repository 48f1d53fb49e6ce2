"""A snapshot of adjusted bars that knows whether it is fresh.

Each refresh writes new folders and then replaces the ledger, so those who
read the old snapshot are not disturbed; the folders of the one before stay
until the next refresh.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources import store

VERSION = "adjust-1"
POLICIES = ("split", "split_dividend")


def watermark(market, generation: str = "none") -> str:
    """What the snapshot depends on: generation, size and reach of actions and bars, and the algorithm's version."""
    a = market.corporate_actions.agg(F.count(F.lit(1)), F.max("ex_date")).first()
    b = market.bars_daily.agg(F.count(F.lit(1)), F.max("market_date")).first()
    return f"gen:{generation}|ca:{a[0]}:{a[1] or ''}|bars:{b[0]}:{b[1] or ''}|{VERSION}"


def _ledger(spark: SparkSession, root: str) -> dict:
    return json.loads(store.read(spark, f"{root}/ledger.json") or b"{}")


def is_fresh(spark: SparkSession, root: str, mark: str) -> bool:
    """Whether every policy's snapshot was built from ``mark``."""
    ledger = _ledger(spark, root)
    return all(ledger.get(p, {}).get("watermark") == mark for p in POLICIES)


def refresh(market, root: str, generation: str = "none", force: bool = False) -> bool:
    """Rebuild the snapshot unless it is fresh; whether it was rebuilt. The ledger is written last."""
    spark, mark = market.bars_daily.sparkSession, watermark(market, generation)
    if not force and is_fresh(spark, root, mark):
        return False
    old = {entry["path"] for entry in _ledger(spark, root).values()}
    ledger, name = {}, f"{hashlib.sha256(mark.encode()).hexdigest()[:12]}-{uuid.uuid4().hex[:8]}"
    for p in POLICIES:
        market.adjusted(p).write.parquet(f"{root}/{p}-{name}")
        ledger[p] = {"watermark": mark, "path": f"{p}-{name}", "version": VERSION}
    store.write(spark, f"{root}/ledger.json", json.dumps(ledger).encode())
    for folder in store.folders(spark, root):
        if folder not in old and not folder.endswith(name):
            store.delete(spark, f"{root}/{folder}")
    return True


def read(spark: SparkSession, root: str, policy: str, mark: str) -> DataFrame | None:
    """The snapshot of a policy if it is fresh."""
    return spark.read.parquet(f"{root}/{_ledger(spark, root)[policy]['path']}") if is_fresh(spark, root, mark) else None
