"""Bars from raw tables, and readers and writers of bar files.

A bar table is long: series, idx (0-based position), ts, open, high, low, close, volume, tb_base, trades.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite, ratio
from tideflow.functions.series import BLOCK, number, running_sum

KLINE_SCHEMA = (
    "open_time long, open double, high double, low double, close double, volume double, close_time long, "
    "quote_volume double, trades double, tb_base double, tb_quote double, ignored string"
)
BUY_TYPES = ("purchase", "signup")


def build_bars(ticks: DataFrame, every: str) -> DataFrame:
    """Time bars of ticks (series, ts, id, price, volume, is_buy): every is a ``date_trunc`` unit."""
    at = F.struct("ts", "id")
    bars = ticks.groupBy("series", F.date_trunc(every, "ts").cast("timestamp_ntz").alias("ts_bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.when(F.col("is_buy"), F.col("volume")).otherwise(0.0)).alias("tb_base"), F.count("*").cast("double").alias("trades"),
    )
    return with_index(bars.withColumnRenamed("ts_bar", "ts"))


def with_index(bars: DataFrame) -> DataFrame:
    return number(bars, ["series"], F.date_trunc("MONTH", "ts"), [F.col("ts")])


def event_ticks(events: DataFrame) -> DataFrame:
    value = finite(F.col("value"))
    return events.select(F.lit("events").alias("series"), "ts", F.col("event_id").alias("id"), value.alias("price"), value.alias("volume"), F.col("event_type").isin(*BUY_TYPES).alias("is_buy"))


def hourly_bars(events: DataFrame) -> DataFrame:
    return build_bars(event_ticks(events), "HOUR")


def daily_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars of shipments: open is the mean unit price, close the next day's; the last day, without a close, is dropped."""
    qty = F.col("l_quantity")
    days = lineitem.groupBy(F.lit("lineitem").alias("series"), F.date_trunc("DAY", "l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        F.sum(qty).alias("volume"), F.sum(F.when(F.col("l_linestatus") == "O", qty).otherwise(0.0)).alias("tb_base"),
        F.count("*").cast("double").alias("trades"), ratio(F.sum("l_extendedprice"), F.sum(qty)).alias("open"),
    )
    w = Window.partitionBy("series").orderBy("ts")  # a row a day, so the calendar bounds it
    days = days.withColumn("close", F.lead("open").over(w))
    days = days.withColumn("high", F.greatest("open", "close")).withColumn("low", F.least("open", "close"))
    return with_index(drop_missing(days))


def event_bars(events: DataFrame) -> DataFrame:
    """One bar an event; flow is the signed value."""
    e = event_ticks(events)
    sign = F.when(F.col("is_buy"), 1.0).otherwise(-1.0)
    order, hour = [F.col("ts"), F.col("id")], F.date_trunc("HOUR", "ts")
    e = number(e.withColumn("flow", sign * F.col("volume")), ["series"], hour, order)
    e = running_sum(e, ["series"], F.floor(F.col("idx") / BLOCK), [F.col("idx")], F.col("flow"), "price")
    return e.select("series", "idx", "ts", F.hour("ts").alias("hour"), F.to_date("ts").alias("day"), "volume", "flow", F.lit(1.0).alias("trades"), "price")


def trade_clock_bars(ticks: DataFrame, trades: int) -> DataFrame:
    """Bars of a constant number of trades; an incomplete last bar is dropped."""
    t = number(ticks, ["series"], F.date_trunc("HOUR", "ts"), [F.col("ts"), F.col("id")], "_place")
    t = t.withColumn("idx", F.floor(F.col("_place") / trades).cast("long"))
    bars = t.groupBy("series", "idx").agg(
        F.min("ts").alias("ts"), F.sum("volume").alias("volume"), F.sum(F.when(F.col("is_buy"), F.col("volume")).otherwise(0.0)).alias("tb_base"), F.count("*").cast("double").alias("trades")
    )
    return bars.where(F.col("trades") == trades)


def dedup_latest(bars: DataFrame, order: Column) -> DataFrame:
    """Of bars of one series and time, the last in ``order`` stays."""
    w = Window.partitionBy("series", "ts").orderBy(order.desc())
    return bars.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with a missing value in any column go; NaN and infinities are missing."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: finite(F.col(c)) for c in doubles}).na.drop()


def read_klines(spark: SparkSession, path: str, series: str) -> DataFrame:
    """Bars of a CSV file in the exchanges' 12-field candle layout (epoch milliseconds, UTC)."""
    k = spark.read.schema(KLINE_SCHEMA).csv(path)
    k = k.select(F.lit(series).alias("series"), F.timestamp_millis("open_time").alias("ts"), *[finite(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "tb_base", "trades")], "close_time")
    return with_index(dedup_latest(k, F.col("close_time")).drop("close_time"))


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    bars.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    kinds = "series string, ts timestamp, open double, high double, low double, close double, volume double, tb_base double, trades double, idx long"
    return spark.read.schema(kinds).format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).load(path)


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document a key, with the key's other columns as rows."""
    rest = [c for c in df.columns if c not in keys]
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*rest))))
    return df.groupBy(*keys).agg(rows.alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
