"""Raw payloads made from the driver's tables, as vendors would send them.

``ROWS`` are the rows of each dataset, in SQL that Spark and DuckDB read alike
(``{table}`` stands for a table); so the readers and facts builders can be held
to SQL over the same rows. Each dataset is written in its own format below one
folder: paged JSON envelopes, arrays, CSV, framed text, with dates in the paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.store import shared_folder

#: Ship dates are moved by 27 years, to lie beside the snapshots.
_DAY = "CAST(l_shipdate AS DATE) + 9862"
_CODE = "CASE WHEN k % 2 = 0 THEN 'sz.' || lpad(CAST(k AS STRING), 6, '0') ELSE 'sh.' || CAST(600000 + k AS STRING) END"
_PRICE = "CAST(floor(l_extendedprice / l_quantity) AS BIGINT)"
ROWS = {
    # two snapshots of tickers: renamed, delisted, without FIGI, with identifiers that several share
    "tickers": """
SELECT CASE WHEN snap = '2025-02-10' AND k % 10 = 0 THEN 'N' ELSE 'S' END || CAST(k AS STRING) AS ticker, CASE WHEN snap = '2025-02-10' THEN s_name || ' Inc' ELSE s_name END AS name,
  CASE k % 6 WHEN 0 THEN 'CS' WHEN 1 THEN 'etf' WHEN 2 THEN 'PFD' WHEN 3 THEN 'zz' WHEN 4 THEN 'ADRC' END AS type, CASE WHEN k % 9 = 0 THEN NULL ELSE k % 4 <> 0 OR (snap = '2025-01-10' AND k % 8 = 0) END AS active,
  CASE WHEN k % 5 = 0 THEN '' ELSE 'usd' END AS currency_name, CASE k % 3 WHEN 0 THEN 'XNYS' WHEN 1 THEN 'XNAS' ELSE '' END AS primary_exchange, 'C' || CAST(CAST(floor(k / 10) AS BIGINT) AS STRING) AS cik,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 7 = 0 THEN NULL ELSE 'F' || CAST(k AS STRING) END AS composite_figi, CASE WHEN k % 3 = 0 THEN NULL ELSE 'SC' || CAST(CAST(floor(k / 2) AS BIGINT) AS STRING) END AS share_class_figi,
  CASE WHEN k % 4 = 0 THEN '2024-0' || CAST(1 + k % 9 AS STRING) || '-15T00:00:00Z' END AS delisted_utc, CASE WHEN k % 12 = 5 THEN NULL ELSE '2025-01-0' || CAST(1 + k % 9 AS STRING) || 'T00:00:00Z' END AS last_updated_utc, snap
FROM (SELECT s_suppkey AS k, s_name, snap FROM {supplier} CROSS JOIN (VALUES ('2025-01-10'), ('2025-02-10')) AS v(snap)) AS r WHERE snap = '2025-01-10' OR k % 2 = 0
UNION ALL SELECT 'DUP', s_name, 'CS', true, 'usd', 'XNYS', NULL, 'D' || CAST(s_suppkey AS STRING), NULL, NULL, '2025-01-01T00:00:00Z', '2025-01-10' FROM {supplier} WHERE s_suppkey <= 3
UNION ALL SELECT NULL, r_name, 'CS', true, 'usd', '', NULL, 'R', NULL, NULL, NULL, '2025-01-10' FROM {region}""",
    "events": """
SELECT 'F' || CAST(s_suppkey AS STRING) AS figi, CASE WHEN n = 1 THEN 'S' ELSE 'N' END || CAST(s_suppkey AS STRING) AS symbol, CASE WHEN n = 1 THEN '2020-01-01' ELSE '2024-06-01' END AS day
FROM {supplier} CROSS JOIN (VALUES (1), (2)) AS v(n) WHERE s_suppkey % 10 = 0""",
    "exchanges": """
SELECT CASE WHEN n_nationkey % 8 = 7 THEN '' ELSE 'X' || CAST(n_nationkey % 11 AS STRING) END AS mic, n_name AS name, 'exchange' AS type, 'stocks' AS asset_class, CASE WHEN r_name = 'AMERICA' THEN 'us' ELSE lower(substr(r_name, 1, 2)) END AS locale, snap
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('2025-01-10'), ('2025-02-10')) AS v(snap) WHERE snap = '2025-01-10' OR n_nationkey % 3 = 0""",
    "holidays": """
SELECT 'NYSE' AS exchange, n_name AS name, CAST(DATE '2025-11-01' + CAST(n_nationkey * 9 + CASE WHEN snap = '2025-01-01' THEN 1 ELSE 0 END AS INT) AS STRING) AS day, CASE n_nationkey % 3 WHEN 0 THEN 'closed' ELSE 'early-close' END AS status, snap
FROM {nation} CROSS JOIN (VALUES ('2025-01-01'), ('2025-02-01')) AS v(snap)""",
    "fetches": f"""
SELECT 'polygon' AS source_id, 'grouped_daily' AS dataset, {_DAY} AS market_date, CAST(CASE WHEN day({_DAY}) = 13 THEN 0 ELSE count(*) END AS INT) AS row_count FROM {{lineitem}} GROUP BY {_DAY}""",
    "splits": f"""
SELECT DISTINCT 'sp' || CAST(l_orderkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST({_DAY} AS STRING) AS id, CASE WHEN l_suppkey % 6 = 0 THEN 'N' ELSE 'S' END || CAST(l_suppkey AS STRING) AS ticker, CAST({_DAY} AS STRING) AS execution_date, 1.0 AS split_from, 2.0 AS split_to FROM {{lineitem}} WHERE l_linenumber = 7""",
    "dividends": f"""
SELECT DISTINCT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE 'dv' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST({_DAY} AS STRING) || '-' || CAST({_PRICE} AS STRING) END AS id, 'S' || CAST(l_suppkey AS STRING) AS ticker, CAST({_DAY} AS STRING) AS ex_dividend_date, CAST({_PRICE} AS DOUBLE) AS cash_amount,
  CASE l_linenumber WHEN 3 THEN 'cad' WHEN 4 THEN '' ELSE 'usd' END AS currency, CAST({_DAY} - 10 AS STRING) AS declaration_date, CASE WHEN l_linenumber = 5 THEN '' ELSE 'CD' END AS dividend_type
FROM {{lineitem}} WHERE l_discount = 0.1 AND l_tax >= 0.07""",
    "daily": f"""
SELECT CASE WHEN l_suppkey % 13 = 0 THEN 'Q' ELSE 'S' END || CAST(l_suppkey AS STRING) AS symbol, CAST(date_trunc('quarter', {_DAY}) AS DATE) AS day, CAST(min({_PRICE}) AS DOUBLE) AS o, CAST(max({_PRICE}) AS DOUBLE) AS h, CAST(min({_PRICE}) AS DOUBLE) AS l, CAST(max({_PRICE}) AS DOUBLE) AS c,
  CAST(sum(l_quantity) AS DOUBLE) AS v, count(*) AS n FROM {{lineitem}} GROUP BY 1, 2""",
    # framed records of the other scope: names that change, codes used twice, rows that are wrong
    "basics": f"""
SELECT CASE WHEN k % 23 = 0 THEN 'xx.' || CAST(k AS STRING) ELSE {_CODE} END AS c1, s_name || CASE WHEN snap = '2024-02-01' AND k % 10 = 0 THEN ' B' ELSE '' END AS c2,
  CASE WHEN k % 13 = 0 THEN 'bad' WHEN k % 29 = 0 THEN '' ELSE CAST(DATE '1990-01-01' + CAST(k % 3000 AS INT) + CASE WHEN snap = '2024-02-01' AND k % 15 = 0 THEN 1 ELSE 0 END AS STRING) END AS c3,
  CASE WHEN k % 9 = 0 THEN CAST(DATE '2022-01-01' + CAST(k % 500 AS INT) AS STRING) ELSE '' END AS c4, CASE WHEN k % 17 = 0 THEN '2' ELSE '1' END AS c5, CASE WHEN k % 9 = 0 THEN '0' ELSE '1' END AS c6, snap
FROM (SELECT s_suppkey AS k, s_name, snap FROM {{supplier}} CROSS JOIN (VALUES ('2024-01-01'), ('2024-02-01')) AS v(snap)) AS r WHERE snap = '2024-01-01' OR k % 5 = 0""",
    "calendar": f"""
SELECT DISTINCT CASE WHEN day({_DAY}) = 28 THEN 'x' || CAST({_DAY} AS STRING) ELSE CAST({_DAY} AS STRING) END AS c1, CASE WHEN day({_DAY}) = 13 THEN '0' WHEN day({_DAY}) = 27 THEN '7' ELSE '1' END AS c2, '2024-03-01' AS snap FROM {{lineitem}}
UNION ALL SELECT '2024-01-02', '1', '2024-01-01' FROM {{region}}""",
    "universe": f"""
SELECT DISTINCT {_CODE} AS c1, CASE WHEN k % 2 = 0 AND month(day) % 4 <> 0 THEN '1' ELSE '0' END AS c2, 'n' AS c3, CAST(day AS STRING) AS field8, '2024-03-01' AS snap
FROM (SELECT l_suppkey AS k, CAST(date_trunc('month', {_DAY}) AS DATE) AS day FROM {{lineitem}}) AS r""",
    "plans": f"""
SELECT {_CODE} AS c1, CASE WHEN k % 7 = 3 THEN '' ELSE CAST(day - 30 AS STRING) END AS c4, CAST(day - 1 AS STRING) AS c6, CASE WHEN k % 21 = 1 THEN 'soon' WHEN k % 21 = 2 THEN '' ELSE CAST(day AS STRING) END AS c7, CAST(day + 3 AS STRING) AS c8,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 19 = 0 THEN 'oops' ELSE '0.' || CAST(1 + price % 9 AS STRING) END AS c10, CASE WHEN k % 4 = 0 THEN 'about 0.25-0.5 yuan' ELSE '' END AS c11, CASE WHEN price % 3 = 0 THEN '0.1' ELSE '' END AS c12, CASE WHEN price % 6 = 0 THEN '0.2' ELSE '' END AS c14, '2024' AS year
FROM (SELECT l_suppkey AS k, max({_DAY}) AS day, max({_PRICE}) AS price FROM {{lineitem}} GROUP BY l_suppkey, year(CAST(l_shipdate AS DATE))) AS r""",
    "k_lines": f"""
SELECT CASE WHEN price % 31 = 0 THEN 'n/a' ELSE CAST(day AS STRING) END AS c1, CASE WHEN price % 31 = 0 THEN 'zz.' || CAST(k AS STRING) || '-' || CAST(day AS STRING) ELSE {_CODE} END AS c2, CAST(price AS STRING) AS c3, CAST(price + CASE WHEN price % 11 = 0 THEN -5 ELSE 5 END AS STRING) AS c4, CAST(price - 5 AS STRING) AS c5, CAST(price + 1 AS STRING) AS c6,
  CASE WHEN price % 13 = 0 THEN '' ELSE CAST(volume AS STRING) END AS c8, CASE WHEN price % 17 = 0 THEN '0' WHEN price % 19 = 0 THEN '5' ELSE '1' END AS c12, '0' AS c14, '2019-01-01_2025-12-31' AS win
FROM (SELECT l_suppkey AS k, {_DAY} AS day, max({_PRICE}) AS price, CAST(sum(l_quantity) AS BIGINT) AS volume FROM {{lineitem}} GROUP BY 1, 2) AS r""",
    "factors": f"""
SELECT CASE WHEN k % 23 = 0 THEN 'zz' ELSE {_CODE} END AS c1, CASE WHEN price % 41 = 0 THEN '?' ELSE CAST(day AS STRING) END AS c2, CASE WHEN price % 37 = 0 THEN '' WHEN price % 43 = 0 THEN '-1' ELSE CAST(1 + price % 7 AS STRING) END AS c4
FROM (SELECT l_suppkey AS k, max({_DAY}) AS day, max({_PRICE}) AS price FROM {{lineitem}} GROUP BY l_suppkey, year(CAST(l_shipdate AS DATE))) AS r""",
}
TABLES = ("supplier", "region", "nation", "lineitem")
#: Rows of one page; how many characters a frame's header has before its length.
PAGE = 1000


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows of a dataset; ``one`` is the same in all."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in ROWS[name]}
    return spark.sql(ROWS[name], **used).withColumn("one", F.lit("2025-02-10"))


def sql(*names: str) -> str:
    """The same rows as common table expressions for DuckDB."""
    return ",\n".join(f"{n}_rows AS ({ROWS[n].format(**{t: t for t in TABLES})})" for n in names)


def _paged(df: DataFrame, key: str, text, path: str) -> str:
    """Write one text for each page of ``df``; pages hold some :data:`PAGE` rows of one ``key``. ``text`` makes it from the list ``r``."""
    cols = [c for c in df.columns if c != key]
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PAGE)).cast("int")
    sizes = df.groupBy(key).agg(n.alias("_n"))
    pages = df.join(F.broadcast(sizes), key).withColumn("_page", F.pmod(F.xxhash64(*cols), "_n"))  # a row for each date
    pages = pages.groupBy(key, "_page").agg(F.collect_list(F.struct(*cols)).alias("r")).select(key, "_page", text.alias("value"))
    # a file is one page: readers take a whole file as one payload
    pages.repartition(key, "_page").write.option("compression", "gzip").partitionBy(key, "_page").text(path)
    return path


def envelopes(spark: SparkSession, df: DataFrame, key: str = "snap", rename: str = "snapshot_date", path: str | None = None) -> str:
    """Pages ``{"results": [...]}`` below ``<rename>=<value>`` in a folder; the folder."""
    path = path or shared_folder(spark, "raw")
    return _paged(df.withColumnRenamed(key, rename), rename, F.to_json(F.struct(F.col("r").alias("results"))), path)


def arrays(spark: SparkSession, df: DataFrame, key: str = "snap", rename: str = "snapshot_date", path: str | None = None) -> str:
    """Pages that are one array."""
    path = path or shared_folder(spark, "raw")
    return _paged(df.withColumnRenamed(key, rename), rename, F.to_json("r"), path)


def frames(spark: SparkSession, df: DataFrame, method: str, width: int, key: str = "snap", rename: str = "snapshot_date", per: str | None = None, path: str | None = None) -> str:
    """Framed responses whose records have the columns c1..c<width> (absent ones empty); ``per``: a column, of one value in each frame, for field 8."""
    path, soh = path or shared_folder(spark, "raw"), "\u0001"
    records = F.transform("r", lambda x: F.array(*[F.coalesce(x[f"c{i}"], F.lit("")) if f"c{i}" in df.columns else F.lit("") for i in range(1, width + 1)]))
    field8 = F.get("r", F.lit(0))[per] if per else F.lit("")
    body = F.concat_ws(soh, F.lit("0"), F.lit("success"), F.lit(method), F.lit(""), F.lit("1"), F.lit(str(PAGE)), F.to_json(F.struct(records.alias("record"))), field8, F.lit(""))
    text = F.concat(F.lit(f"00.9.10{soh}12{soh}"), F.lpad(F.char_length(body).cast("string"), 10, "0"), body)
    df = df.withColumnRenamed(key, rename)
    if per:
        df = df.withColumn(rename, F.concat(rename, F.lit("_"), per))
    return _paged(df, rename, text, path)
