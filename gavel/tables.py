"""The bid table over the test tables, and the tables it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# One bid for each lineitem row, in whole-number arithmetic; the same text runs on Spark and on DuckDB.
_STEPS = """src AS (
  SELECT CAST(l_orderkey AS BIGINT) AS ok, CAST(l_partkey AS BIGINT) AS pk, CAST(l_suppkey AS BIGINT) AS sk,
         CAST(l_linenumber AS BIGINT) AS ln,
         CAST(year(l_shipdate) AS BIGINT)*10000 + CAST(month(l_shipdate) AS BIGINT)*100 + CAST(day(l_shipdate) AS BIGINT) AS dd,
         CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
              ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS rn
  FROM {lineitem}),
k AS (
  SELECT *, ok*10000 + ln*1000 + rn AS bidid, 1 + (ok % 3) AS adexchange, sk % 5 AS a,
         (pk*7919 + ok*104729 + ln*1299709 + rn*15485863) % 1009 AS u,
         (ok*7 + ln*5 + pk) % 24 AS hour
  FROM src),
p AS (
  SELECT *,
    CASE a WHEN 0 THEN 1458 WHEN 1 THEN 3358 WHEN 2 THEN 3386 WHEN 3 THEN 3427 ELSE 3476 END AS advertiser,
    CASE a WHEN 0 THEN 300 WHEN 2 THEN 300
           WHEN 1 THEN CASE WHEN pk % 2 = 0 THEN 227 ELSE 238 END
           WHEN 3 THEN CASE WHEN pk % 2 = 0 THEN 238 ELSE 254 END
           ELSE CASE WHEN pk % 2 = 0 THEN 277 ELSE 294 END END AS bidprice,
    CASE adexchange WHEN 1 THEN 0 WHEN 2 THEN (pk % 3)*5 ELSE 40 + (pk % 7)*10 END AS slotprice,
    CASE adexchange WHEN 1 THEN u % 520 + 1 WHEN 2 THEN u % 700 + 1 ELSE u + 20 END AS mraw
  FROM k),
m AS (SELECT *, CASE WHEN mraw > slotprice THEN mraw ELSE slotprice END AS market FROM p),
w AS (SELECT *, CASE WHEN market <= bidprice THEN 1 ELSE 0 END AS win FROM m),
bids AS (
SELECT bidid, dd AS day, CAST(CASE WHEN dd < 19980701 THEN 2 ELSE 3 END AS INT) AS season,
       CAST(dd*1000000000 + hour*10000000 + ((ok + pk*3) % 60)*100000 + (ok % 60)*1000 + ln AS VARCHAR(20)) AS timestamp,
       CAST(hour AS INT) AS hour, CAST((ok + pk*3) % 60 AS INT) AS minute,
       CAST((sk*7 + pk) % 35 AS INT) AS region, CAST((sk*11 + pk) % 360 AS INT) AS city,
       CAST(adexchange AS INT) AS adexchange, CAST(advertiser AS INT) AS advertiser,
       CASE WHEN pk % 97 = 0 THEN NULL ELSE concat('d', CAST((pk*pk) % 401 AS VARCHAR(10))) END AS domain,
       concat('c', CAST((sk*3 + a) % 53 AS VARCHAR(10))) AS creative,
       CAST(CASE pk % 4 WHEN 0 THEN 300 WHEN 1 THEN 728 WHEN 2 THEN 160 ELSE 950 END AS INT) AS slotwidth,
       CAST(CASE pk % 4 WHEN 0 THEN 250 WHEN 1 THEN 90 WHEN 2 THEN 600 ELSE 90 END AS INT) AS slotheight,
       CAST(CASE WHEN adexchange = 1 AND pk % 29 = 0 THEN 255 ELSE pk % 3 END AS INT) AS slotvisibility,
       CAST(CASE WHEN pk % 41 = 0 THEN 5 ELSE pk % 2 END AS INT) AS slotformat,
       CAST(slotprice AS INT) AS slotprice, CAST(bidprice AS INT) AS bidprice,
       CAST(CASE WHEN win = 1 THEN market ELSE 0 END AS INT) AS payprice, CAST(market AS INT) AS market_truth,
       CAST(win AS INT) AS win,
       CAST(CASE WHEN win = 1 AND (ok*31 + ln*17 + pk*13) % 50 < 1 + (a % 3) THEN 1 ELSE 0 END AS INT) AS click,
       CAST(CASE WHEN win = 1 AND (ok*31 + ln*17 + pk*13) % 50 < 1 + (a % 3) AND pk % 4 = 0 THEN 1 ELSE 0 END AS INT) AS conversion,
       CASE WHEN win = 1 AND pk % 5 > 0 THEN concat(CAST(10000 + pk % 17 AS VARCHAR(10)), ',', CAST(10000 + ok % 23 AS VARCHAR(10)), ',', CAST(10000 + sk % 11 AS VARCHAR(10))) ELSE NULL END AS usertag,
       CAST(1 + (ok*31 + pk*7 + ln*3) % 60 AS DOUBLE) / 1000.0 AS p_a,
       CAST(1 + (ok*31 + pk*7 + ln*3 + a*9) % 60 AS DOUBLE) / 1200.0 AS p_b
FROM w)"""
BIDS_CTE = "WITH " + _STEPS.replace("{lineitem}", "lineitem") + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bid: labels win, click and conversion, prices, slot, user tags and two model scores p_a and p_b."""
    return spark.sql("WITH " + _STEPS + " SELECT * FROM bids", lineitem=table(spark, sf_dir, "lineitem"))


def scores(df: DataFrame) -> DataFrame:
    """Bids as one row for each model: the columns, `model` and its probability `p`."""
    return df.unpivot([c for c in df.columns if c not in ("p_a", "p_b")], ["p_a", "p_b"], "model", "p")
