"""Labelled events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.identifiers import event_hash
from tickspark.names import EVENT_TIME, GROUP, TARGET

_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_labels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A JSON array of {symbol, time, exchange}, or one object per line with ``lines``, as events."""
    schema = "symbol STRING, time STRING, exchange STRING"
    return parse_labels(spark.read.schema(schema).json(path, multiLine=not lines))


def parse_labels(raw: DataFrame) -> DataFrame:
    at = F.to_timestamp_ntz("time", F.lit(_TIME_FORMAT))
    exchange = F.upper("exchange")
    return raw.select(
        event_hash(F.col("symbol"), at, exchange).alias(GROUP),
        F.col("symbol").alias(TARGET),
        at.alias(EVENT_TIME),
        exchange.alias("exchange"),
    )


def write_dropped(events: DataFrame, path: str, exchange: str = "BINANCE_SPOT") -> None:
    """Events left out of the panel as JSON lines of {currency_pair, time, exchange}."""
    venue = F.col("exchange") if "exchange" in events.columns else F.lit(exchange)
    events.select(
        F.col(TARGET).alias("currency_pair"),
        F.date_format(EVENT_TIME, "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
        venue.alias("exchange"),
    ).write.mode("overwrite").json(path)
