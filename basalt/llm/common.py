"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import io
import os
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared checkpoint folder (tests, laptops).
LOCAL_CHECKPOINT_DIR = "file:///tmp/checkpoints/basalt"
#: Rows and bytes in one Arrow batch: a batch of long texts stays a few MB.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_workspaces: dict[str, str] = {}
_shipped: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; our own only where that is unset and one machine does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    return named or LOCAL_CHECKPOINT_DIR


def workspace(spark: SparkSession) -> str:
    """A folder of this application under :func:`shared_dir`, removed when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _workspaces:
        _workspaces[app] = f"{shared_dir(spark).rstrip('/')}/basalt-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clear_workspace, spark)
    return _workspaces[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of intermediate rows."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def clear_workspace(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them end."""
    root = _workspaces.pop(spark.sparkContext.applicationId, None) if spark.sparkContext._jsc else None
    if root:
        delete_path(spark, root)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, fewer_files: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage: a lost executor costs only tasks of the reader, never the
    work before the write. ``fewer_files``, for rows much smaller than what
    was shuffled to make them: a file for four shuffle partitions.
    """
    path = new_path(df.sparkSession, name)
    schema = df.schema
    if fewer_files:
        df = df.coalesce(max(48, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    if path := _paths.pop(df, None):
        delete_path(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that their Python needs no path to it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root, data = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(path := os.path.join(folder, n), os.path.relpath(path, os.path.dirname(root)))
    path = f"{workspace(spark)}/basalt.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(path)


def small_batches(spark: SparkSession) -> None:
    """Ready the session for Python operators: ship the package, and bound Arrow batches by rows and
    bytes, where the user has not chosen otherwise."""
    ship(spark)
    for key, value, default in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, "10000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, "268435456"),
    ):
        now = spark.conf.get(key, default)
        if now in (default, f"{default}b", "256MB", "256m", "-1"):
            spark.conf.set(key, str(value))


def ascii_lower(col):
    """A-Z to a-z and nothing else. The JVM's own lower() is used where a text is ASCII only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quiet_threads() -> None:
    """One thread for each Python worker: Spark's cores are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


class Memory:
    """What a Python worker remembers of words: at most ``limit`` entries, of which those in use survive.

    When it is full, the entries become the old generation, from which the
    ones that are asked for again return. ``data`` is a plain dict, which sets
    know how to search.
    """

    def __init__(self, limit: int = 400_000):
        self.limit, self.old, self.data = limit // 2, {}, {}

    def learn(self, keys: set, make) -> None:
        """Make sure that all ``keys`` are in ``data``; ``make`` gives the values of a list of new ones."""
        data = self.data
        new = keys.difference(data)
        if not new:
            return
        if len(data) + len(new) > self.limit:
            self.old = dict(data)
            data.clear()
            new = keys
        if self.old:
            back = {k: self.old[k] for k in new if k in self.old}
            data.update(back)
            new = new.difference(back)
        new = list(new)
        data.update(zip(new, make(new), strict=True))

    def values(self, keys: list, make) -> list:
        """The values of ``keys``, new ones made together."""
        self.learn(set(keys), make)
        return list(map(self.data.__getitem__, keys))
