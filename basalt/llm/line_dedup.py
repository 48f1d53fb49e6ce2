"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z in lower case;
keys of at least :data:`MIN_CHARS` code points count. Documents come in
batches. A batch's keys are first reduced to one row each (with the smallest
and the largest doc_id), then merge-joined with the runs that earlier batches
left; keys that no run has form the batch's own run. Runs are tables bucketed
and sorted by the key's hash, so this join needs no shuffle of any run. When a
level holds :data:`FANOUT` runs they are compacted into one of the next level.

A run says for each key which document owns it and whether other documents
have it. Lines of other documents with such a key are dropped. The lines
of a hot key meet its one row in a plain sort-merge join, which adaptive
execution splits; nothing is gathered by key.

Defined results: a null or empty text is one empty line; empty texts, short
keys and null doc_ids lose nothing, and a null doc_id never owns a key; rows
that repeat a doc_id are one document; documents of one batch and of later
batches with a smaller doc_id: the earlier batch owns; an empty table gives
an empty result; other columns stay out of the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm.common import ascii_lower, delete_path, materialise, new_path

MIN_CHARS = 10
#: Runs of one level before they are compacted; batches that a table is taken in.
FANOUT, BATCHES = 3, 4
SPACE = " \t\n\x0b\x0c\r"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, h1, h2: a row for each line whose key counts; the two hashes are 128 bits of the key."""
    at = docs.filter("doc_id is not null").select("doc_id", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = at.select("doc_id", "pos", F.btrim("line", F.lit(SPACE)).alias("line")).filter(F.char_length("line") >= MIN_CHARS)
    keys = keys.select("doc_id", "pos", ascii_lower(F.col("line")).alias("key"))
    return keys.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


class LineStore:
    """Runs of keys. ``add`` takes a batch's keyed lines; ``shared`` are the keys of several documents."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, f"line-run-{level}")
        (rows.write.format("parquet").option("path", path).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in reversed(self.levels) for name, _ in level]

    def compact(self) -> None:
        """Merge full levels upwards."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= FANOUT:
                old, self.levels[level] = self.levels[level], []
                rows = [self.spark.table(name) for name, _ in old]
                merged = rows[0]
                for r in rows[1:]:
                    merged = merged.unionByName(r)
                # A key is fresh in one run only; in later ones it says that more documents have it.
                merged = merged.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.bool_or("fresh").alias("fresh"), F.bool_or("shared").alias("shared"))
                self._write(merged, level + 1)
                self._drop(old)

    def _drop(self, runs) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)

    def add(self, lines: DataFrame) -> None:
        """Anti-join a batch's keys with the runs and add its own run."""
        self.compact()
        new = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        owner = F.lit(None).cast("long")
        for k, run in enumerate(self.runs()):
            new = new.join(run.filter("fresh").select("h1", "h2", F.col("owner").alias(f"owner{k}")), ["h1", "h2"], "left")
            owner = F.coalesce(owner, f"owner{k}")
        mine = F.coalesce(owner, "first")
        self._write(new.select("h1", "h2", mine.alias("owner"), owner.isNull().alias("fresh"), (F.col("last") != mine).alias("shared")), 0)

    def shared(self) -> DataFrame:
        """h1, h2, owner of the keys that several documents have."""
        rows = None
        for run in self.runs():
            run = run.filter("shared").select("h1", "h2", "owner")
            rows = run if rows is None else rows.unionByName(run)
        return rows.groupBy("h1", "h2").agg(F.min("owner").alias("owner"))

    def close(self) -> None:
        self._drop([x for level in self.levels for x in level])
        self.levels = []


def dropped(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, drop (array<int>): the lines that each document loses; only documents that lose some."""
    spark = docs.sparkSession
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    batch = F.lit(0)
    for c in sorted(set(cuts)):
        batch = batch + (F.col("doc_id") > c).cast("int")
    lines = materialise(keyed_lines(docs).withColumn("batch", batch), "lines")
    store = LineStore(spark)
    try:
        for k in range(len(set(cuts)) + 1):
            store.add(lines.filter(F.col("batch") == k))
        shared = materialise(store.shared(), "shared-lines", fewer_files=True)
    finally:  # the runs are tables of the session's catalog
        store.close()
    lost = lines.join(shared, ["h1", "h2"]).filter(F.col("doc_id") != F.col("owner"))
    return lost.groupBy("doc_id").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_dropped and kept (the remaining text, null where the text
    was null and nothing is dropped); columns of these names are replaced."""
    rest = docs.drop("n_lines", "n_dropped", "kept")
    lost = dropped(docs.select("doc_id", "text"), batches).withColumnRenamed("doc_id", "_lost_doc_id").withColumnRenamed("drop", "_lost_lines")
    rows = rest.join(lost, F.col("doc_id") == F.col("_lost_doc_id"), "left")
    lines, text = _lines(F.col("text")), F.coalesce("text", F.lit(""))
    n = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.filter("_lost_lines", lambda i: i < F.size(lines)))
    kept = F.when(F.col("_lost_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    gone = F.coalesce(F.size(F.filter("_lost_lines", lambda i: i < n)), F.lit(0))
    return rows.select(*[rest[c] for c in rest.columns], n.cast("long").alias("n_lines"), F.greatest(gone, F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every line of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


SQL = """
WITH l AS (
  SELECT doc_id, unnest(generate_series(1, len(ls))) AS p, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), k AS (
  SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), f AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
