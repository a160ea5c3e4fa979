"""Price bars: scans, ingest of wide vendor tables, sinks and a quality report.

A bars table has one row for each (ticker, date): open, high, low, close, adj_close, volume, and carried columns. NaN is
read as null. All functions take and return DataFrames.
"""

from __future__ import annotations

import datetime
import re
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlewick.functions.scalars import no_nan

PRICES = ["open", "high", "low", "close", "adj_close"]
# A vendor's field names, and ours for them.
VENDOR_FIELDS = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
    "Dividends": "dividends",
    "Stock Splits": "stock_splits",
}
BAR_COLUMNS = ["date", "ticker", "company", *VENDOR_FIELDS.values()]

# The default constituents, as (ticker, company).
CONSTITUENTS = [
    ("AC.PA", "Accor"),
    ("AI.PA", "Air Liquide"),
    ("AIR.PA", "Airbus"),
    ("MT.AS", "ArcelorMittal"),
    ("CS.PA", "AXA"),
    ("BNP.PA", "BNP Paribas"),
    ("EN.PA", "Bouygues"),
    ("BVI.PA", "Bureau Veritas"),
    ("CAP.PA", "Capgemini"),
    ("CA.PA", "Carrefour"),
    ("ACA.PA", "Credit Agricole"),
    ("BN.PA", "Danone"),
    ("DSY.PA", "Dassault Systemes"),
    ("FGR.PA", "Eiffage"),
    ("ENGI.PA", "Engie"),
    ("EL.PA", "EssilorLuxottica"),
    ("ERF.PA", "Eurofins Scientific"),
    ("ENX.PA", "Euronext"),
    ("RMS.PA", "Hermes"),
    ("KER.PA", "Kering"),
    ("LR.PA", "Legrand"),
    ("OR.PA", "L'Oreal"),
    ("MC.PA", "LVMH"),
    ("ML.PA", "Michelin"),
    ("ORA.PA", "Orange"),
    ("RI.PA", "Pernod Ricard"),
    ("PUB.PA", "Publicis Groupe"),
    ("RNO.PA", "Renault"),
    ("SAF.PA", "Safran"),
    ("SGO.PA", "Saint-Gobain"),
    ("SAN.PA", "Sanofi"),
    ("SU.PA", "Schneider Electric"),
    ("GLE.PA", "Societe Generale"),
    ("STLAP.PA", "Stellantis"),
    ("STMPA.PA", "STMicroelectronics"),
    ("HO.PA", "Thales"),
    ("TTE.PA", "TotalEnergies"),
    ("URW.PA", "Unibail-Rodamco-Westfield"),
    ("VIE.PA", "Veolia Environnement"),
    ("DG.PA", "Vinci"),
]


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
    """Scan a Parquet dataset (partitioned or not); Spark pushes the predicate and the columns into the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return clean(df.select(*columns) if columns else df)


def clean(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: no_nan(F.col(c)) for c in floats}) if floats else df


def constituents(spark: SparkSession, path: str | None = None) -> DataFrame:
    """ticker and company, sorted by ticker: the default list, or a headed CSV."""
    if path:
        return spark.read.option("header", True).schema("ticker string, company string").csv(path).orderBy("ticker")
    return spark.createDataFrame(CONSTITUENTS, "ticker string, company string").orderBy("ticker")


def with_company(bars: DataFrame, dimension: DataFrame) -> DataFrame:
    """Look up ``company`` by ticker; a ticker without one is an error when the plan runs. The dimension is one row a ticker."""
    named = bars.drop("company").join(dimension.select("ticker", "company"), "ticker", "left")
    known = F.when(F.col("company").isNotNull(), F.col("company")).otherwise(F.raise_error(F.concat(F.lit("no company for ticker "), F.coalesce("ticker", F.lit("null")))))
    return named.withColumn("company", known.cast("string"))


def wide_to_long(wide: DataFrame, date: str = "Date", separator: str = "|") -> DataFrame:
    """One row for each (date, ticker) of a table with a column ``ticker<separator>field`` for each pair.

    Fields that a ticker lacks are null; rows without any value are left out.
    """
    pairs = [c for c in wide.columns if c != date and separator in c]
    cells = wide.select(F.col(date).alias("date"), *[F.col(f"`{c}`").cast("double").alias(c) for c in pairs]).unpivot("date", pairs, "cell", "value")
    at = F.split_part("cell", F.lit(separator), F.lit(1)), F.split_part("cell", F.lit(separator), F.lit(2))
    cells = cells.select("date", at[0].alias("ticker"), at[1].alias("field"), no_nan(F.col("value")).alias("value")).where("value IS NOT NULL")
    fields = [F.max(F.when(F.col("field") == k, F.col("value"))).alias(v) for k, v in VENDOR_FIELDS.items()]
    return cells.groupBy("date", "ticker").agg(*fields)


def normalised(long: DataFrame, dimension: DataFrame) -> DataFrame:
    """The fixed columns and their order, with company names; missing columns are null."""
    named = with_company(long.withColumnsRenamed({k: v for k, v in VENDOR_FIELDS.items() if k in long.columns}), dimension)
    have = set(named.columns)
    return named.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in BAR_COLUMNS])


def date_range(bars: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Bars from ``start`` to ``end``, both inclusive; dates are ``YYYY-MM-DD``."""
    for text in filter(None, (start, end)):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            raise ValueError(f"not a YYYY-MM-DD date: {text}")
    first, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end) if end else None
    if last and last < first:
        raise ValueError("the range ends before it starts")
    kept = F.col("date") >= F.lit(first)
    return bars.where(kept & (F.col("date") < F.lit(last + datetime.timedelta(1))) if last else kept)


def coerced_dates(df: DataFrame) -> DataFrame:
    """Text dates as timestamps; one that cannot be read is an error when the plan runs."""
    parsed = F.col("date").cast("string").try_cast("timestamp_ntz")
    return df.withColumn("date", F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("a date is null or cannot be read")).cast("timestamp_ntz")))


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"))


def quality_report(bars: DataFrame) -> DataFrame:
    """One row: null keys, keys that occur twice or more, and rows, which all window operators rely on."""
    keys = bars.groupBy("ticker", "date").agg(F.count("*").alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("ticker").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_tickers"),
        F.coalesce(F.sum(F.when(F.col("date").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_dates"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
    )


def order_report(bars: DataFrame, arrival: str) -> DataFrame:
    """Rows of each ticker, and those that arrived (by the column ``arrival``) after a row of a later date: a series that was
    mixed up on its way in has some."""
    step = F.col("date") < F.lag("date").over(Window.partitionBy("ticker").orderBy(arrival))
    return bars.withColumn("_back", step).groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count_if("_back").alias("n_backward"))


def ordered_by_key(bars: DataFrame) -> DataFrame:
    """``bars``, or an error when the plan runs over a null or repeated (ticker, date). Repeats are neighbours in the order
    that all window operators sort by, so the check shares their shuffle and sort."""
    repeated = F.col("date").eqNullSafe(F.lag("date").over(Window.partitionBy("ticker").orderBy("date")))
    bad = F.col("ticker").isNull() | F.col("date").isNull() | repeated
    return bars.withColumn("_ok", F.when(bad, F.raise_error(F.lit("null or repeated (ticker, date)")).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")


def write_csv(bars: DataFrame, path: str) -> int:
    """Write CSV with a header; bytes written."""
    bars.write.mode("overwrite").option("header", True).csv(path)
    return _bytes(bars.sparkSession, path)


def write_parquet(bars: DataFrame, path: str, by_ticker: bool = False) -> int:
    """Write Parquet, a folder for each ticker on demand; bytes written."""
    writer = bars.write.mode("overwrite")
    (writer.partitionBy("ticker") if by_ticker else writer).parquet(path)
    return _bytes(bars.sparkSession, path)


def _bytes(spark: SparkSession, path: str) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length").alias("n")).first()["n"] or 0


def write_bucketed(bars: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """A table of the catalog whose files lie by ticker, sorted by date: window operators read it without an exchange. Its
    files go to ``path``, or to the warehouse."""
    writer = bars.repartition(buckets, "ticker").write.mode("overwrite").bucketBy(buckets, "ticker").sortBy("ticker", "date").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return bars.sparkSession.table(table)


def save(bars: DataFrame, base: str, kind: str = "auto") -> str:
    """Save under ``base`` as ``csv``, ``parquet`` or the smaller of both (equal sizes: CSV); the path that stays.

    All is written to a staging folder beside it first. What was there is moved aside after that, and one rename puts the new
    one in place: a write or a rename that fails leaves what was there, and never are there two formats. A failed Parquet
    write keeps the CSV and warns.
    """
    if kind not in ("auto", "csv", "parquet"):
        raise ValueError(f"unknown format: {kind}")
    spark, staged = bars.sparkSession, f"{base}.staged-{uuid.uuid4().hex}"
    try:
        if kind == "auto":
            sizes = {"csv": write_csv(bars, f"{staged}/csv")}
            try:
                sizes["parquet"] = write_parquet(bars, f"{staged}/parquet")
            except (PySparkException, Py4JJavaError) as error:
                warnings.warn(f"kept CSV, Parquet could not be written: {error}", stacklevel=2)
            kept = "parquet" if sizes.get("parquet", sizes["csv"]) < sizes["csv"] else "csv"
        else:
            kept = kind
            (write_csv if kind == "csv" else write_parquet)(bars, f"{staged}/{kind}")
        aside = [other for other in ("csv", "parquet") if _exists(spark, f"{base}.{other}")]
        for other in aside:
            _rename(spark, f"{base}.{other}", f"{staged}/old-{other}")
        try:
            _rename(spark, f"{staged}/{kept}", f"{base}.{kept}")
        except Exception:
            for other in aside:
                _rename(spark, f"{staged}/old-{other}", f"{base}.{other}")
            raise
    finally:
        _delete(spark, staged)
    return f"{base}.{kept}"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    at, to = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to):
        raise OSError(f"cannot rename {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
