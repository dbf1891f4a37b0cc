"""Raw logs, unification, validation, manifests, splits and samples (S)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from gavel.operators.order import lowest

_INTS = {"region", "city", "adexchange", "slotwidth", "slotheight", "slotvisibility", "slotformat", "slotprice", "bidprice", "advertiser", "payprice"}
BID_COLUMNS = ["bidid", "timestamp", "ipinyouid", "useragent", "ip", "region", "city", "adexchange", "domain", "url", "urlid", "slotid", "slotwidth", "slotheight", "slotvisibility", "slotformat", "slotprice", "creative", "bidprice", "advertiser", "usertag"]
EVENT_COLUMNS = ["bidid", "timestamp", "logtype", *BID_COLUMNS[2:], "payprice", "keypageurl"]
UNIFIED = ["bidid", "timestamp", "region", "city", "adexchange", "domain", "slotwidth", "slotheight", "slotvisibility", "slotformat", "slotprice", "creative", "bidprice", "advertiser", "usertag", "win", "click", "conversion", "payprice", "season", "day"]
_HOME: dict[str, str] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """An unused path in the cluster's shared folder. One machine may do without; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    top = top or _HOME.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df's rows, written to the shared folder (partitioned by some columns) and read back: for results that a plan uses several times.

    Their plan is a scan whose size Spark knows, so that a join broadcasts them only where they are small.
    """
    path = fresh(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, IntegerType() if c in _INTS else StringType()) for c in columns])


def read_logs(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Tab-separated logs (bz2 or plain) of a kind: bid, imp, clk or conv; a column subset and a row cap if asked."""
    df = spark.read.csv(path, sep="\t", schema=schema(BID_COLUMNS if kind == "bid" else EVENT_COLUMNS), quote="", nullValue="null")
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows else df


def write_logs(df: DataFrame, path: str, columns: list[str], compression: str = "bzip2") -> None:
    """Write rows in the raw form; columns that df lacks are null."""
    have = [(F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in columns]
    df.select(*have).write.csv(path, sep="\t", compression=compression, nullValue="null", quote="", emptyValue="")


def unify(bids: DataFrame, imps: DataFrame, clks: DataFrame, convs: DataFrame) -> DataFrame:
    """Bids with win, click, conversion and payprice by id; a click or conversion without a win doesn't count."""
    one = lambda df, flag: df.select("bidid").distinct().withColumn(flag, F.lit(1))
    paid = imps.groupBy("bidid").agg(F.max("payprice").alias("payprice")).withColumn("win", F.lit(1))
    out = bids.join(paid, "bidid", "left").join(one(clks, "click"), "bidid", "left").join(one(convs, "conversion"), "bidid", "left")
    win = F.coalesce("win", F.lit(0))
    click = F.coalesce("click", F.lit(0)) * win
    return out.withColumns({"payprice": F.coalesce("payprice", F.lit(0)), "win": win, "click": click, "conversion": F.coalesce("conversion", F.lit(0)) * click, "day": F.substring("timestamp", 1, 8).cast("long")})


def write_unified(df: DataFrame, path: str) -> None:
    """S3: one folder for each season and day."""
    df.write.partitionBy("season", "day").parquet(path)


def scan_unified(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of a unified table; others are not read."""
    return spark.read.parquet(path).select(*columns)


def validate(df: DataFrame, required: list[str]) -> DataFrame:
    """(problem, n): missing columns, labels that break click <= win or conversion <= click, negative prices, repeated ids."""
    spark = df.sparkSession
    missing = [c for c in required if c not in df.columns]
    checks = {"click_without_win": "click > win", "conversion_without_click": "conversion > click", "price_on_loss": "win = 0 and payprice <> 0", "paid_over_bid": "payprice > bidprice", "bad_label": "win not in (0, 1) or click not in (0, 1)"}
    counted = df.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()]).unpivot([], list(checks), "problem", "n")
    repeated = df.groupBy("bidid").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_bidid").alias("problem"), "n")
    return counted.unionByName(repeated).unionByName(spark.range(1).select(F.lit("missing_columns").alias("problem"), F.lit(len(missing)).cast("long").alias("n")))


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """N rows of the lowest hash."""
    return lowest(df, F.xxhash64("bidid", F.lit(seed)), "bidid", n)


def manifest(df: DataFrame, split: str, expected: int | None, required: list[str], win_band: tuple[float, float] = (0.1, 0.9), ctr_band: tuple[float, float] = (0.0, 0.2), limit: float = 1e-4) -> DataFrame:
    """One row for a split: rows, schema hash, missing columns, bad labels, clicks without wins, rates and a verdict."""
    missing = sum(c not in df.columns for c in required)
    got = df.agg(F.count("*").alias("rows"), F.count_if(F.expr("win not in (0, 1) or click not in (0, 1)")).alias("bad_labels"), F.count_if(F.expr("click > win")).alias("click_over_win"), F.avg("win").alias("win_rate"), F.coalesce(F.sum("click") / F.nullif(F.sum("win"), F.lit(0)), F.lit(0.0)).alias("ctr"))
    rate = F.col("click_over_win") / F.greatest("rows", F.lit(1))
    verdict = F.when((F.lit(missing) > 0) | (F.col("bad_labels") > 0) | (rate > limit) | (F.lit(expected is not None) & (F.col("rows") != F.lit(expected or 0))), "fail").when((F.col("click_over_win") > 0) | ~F.col("win_rate").between(*win_band) | ~F.col("ctr").between(*ctr_band), "warn").otherwise("ok")
    names = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return got.withColumns({"split": F.lit(split), "schema_hash": F.substring(F.sha2(F.lit(names), 256), 1, 16), "missing": F.lit(missing), "verdict": verdict})


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Rows by split, plain types, and a table of metadata beside them; returns the metadata."""
    plain: list[Column] = [F.col(c).cast("string") if t in ("void",) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.partitionBy("split").parquet(f"{path}/rows")
    meta = df.groupBy("split").agg(F.count("*").alias("rows"))
    meta.write.json(f"{path}/metadata")
    return meta


def read_splits(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Some columns of the splits; null whole numbers are 0, null doubles stay."""
    df = spark.read.parquet(f"{path}/rows").select(*columns)
    return df.fillna(0, [c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")])


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    """S11."""
    (df.write.json(path) if kind == "json" else df.write.csv(path, header=True))


def load_results(spark: SparkSession, nested: str, flat: str) -> DataFrame:
    """Results of two forms as one: nested {model, context, metrics: {...}} and flat {model_name, auc, ...}."""
    a = spark.read.schema("model string, context string, metrics struct<auc:double,log_loss:double,ece:double,ieb:double>").json(nested).select("model", F.lit("nested").alias("type"), "context", "metrics.*")
    b = spark.read.schema("model_name string, auc double, log_loss double, ece double, ieb double").json(flat).select(F.col("model_name").alias("model"), F.lit("flat").alias("type"), "auc", "log_loss", "ece", "ieb")
    return a.unionByName(b, allowMissingColumns=True)


def first_rows(spark: SparkSession, path: str, n: int, columns: dict[str, tuple[float, float]], order: list[str]) -> DataFrame:
    """The first n rows in an order (nulls first) of a few columns, as z-scores clipped to -5..5. Files have no order of their own once several tasks read them; ties should be equal in the columns."""
    df = spark.read.parquet(path).orderBy(*order).limit(n)
    return df.select(*[F.least(F.greatest((F.col(c) - m) / s, F.lit(-5.0)), F.lit(5.0)).alias(c) for c, (m, s) in columns.items()])
