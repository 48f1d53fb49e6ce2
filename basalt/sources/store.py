"""Small files and folders in any store that Spark reads, through its own file system layer.

Data goes through Spark; pointers, ledgers and landed payloads go through here,
so that both land in the same place on a cluster.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write(spark: SparkSession, path: str, data: bytes) -> None:
    """Write beside, then take the place of what is there in one step."""
    fs, part = _at(spark, f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    move(spark, part.toString(), path)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file or folder; an existing file is replaced."""
    fs, source = _at(spark, old)
    target = _at(spark, new)[1]
    jvm = spark._jvm
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.valueOf("OVERWRITE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(source), fs.makeQualified(target), how)


def read(spark: SparkSession, path: str) -> bytes | None:
    """The file's bytes; None where there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder matches."""
    fs, p = _at(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, in order."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of all files below ``path``, relative to it, in order."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return []
    root, out, found = fs.getFileStatus(p).getPath().toUri().getPath(), [], fs.listFiles(p, True)
    while found.hasNext():
        out.append(found.next().getPath().toUri().getPath()[len(root.rstrip("/")) + 1 :])
    return sorted(out)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see, removed when Python ends: below ``spark.checkpoint.dir``, or on this
    machine if it does all the work."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
    path = f"{(named or 'file:///tmp/checkpoints/basalt').rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(lambda: spark.sparkContext._jsc and delete(spark, path))
    return path
