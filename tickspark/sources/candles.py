"""One-minute candle archives: cleaning, minute grids and reference rates."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.calendar import floor_time, start_of_day
from tickspark.functions.numeric import coerce_numeric
from tickspark.names import CANDLE_COLUMNS

_VALUES = ["open_price", "close_price", "quote_asset_volume", "taker_buy_quote_asset_volume"]
_TEXT_SCHEMA = "path STRING, position BIGINT, " + ", ".join(f"{c} STRING" for c in CANDLE_COLUMNS)
_NAME = r"([^/]+)/[^/]*@(\d{4}-\d{2}-\d{2})\.zip$"


def parse_candle_archives(archives: DataFrame) -> DataFrame:
    """Unzip headerless candle CSVs (``path``, ``content``) as text columns with symbol and line number."""
    names = list(CANDLE_COLUMNS)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with archive.open(member) as stream:
                            rows = pd.read_csv(stream, header=None, names=names, dtype=str, keep_default_na=False)
                        yield rows.assign(path=path, position=range(len(rows)))[["path", "position", *names]]

    parsed = archives.select("path", "content").mapInPandas(unzip, _TEXT_SCHEMA)
    opened = F.timestamp_millis(F.expr("try_cast(open_time AS BIGINT)"))
    return parsed.withColumns(
        {"symbol": F.regexp_extract("path", _NAME, 1), "open_time": opened.cast("timestamp_ntz")}
    ).drop("path")


def deduplicate(candles: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the last row of each key by ``order``, as one aggregate with map-side reduction."""
    keys = list(keys)
    values = [c for c in candles.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.col(order)).alias("_last")
    return candles.groupBy(*keys).agg(last).select(*keys, "_last.*")


def clean_candles(candles: DataFrame, order: str = "position") -> DataFrame:
    """Numbers from text, incomplete candles dropped, duplicates resolved to the last one."""
    required = ["open_time", "open_price", "close_price", "quote_asset_volume"]
    typed = coerce_numeric(candles, _VALUES, required)
    unique = deduplicate(typed.select("symbol", "open_time", *_VALUES, order), ["symbol", "open_time"], order)
    return unique.drop(order)


def minute_grid(candles: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Candles of [start, end) on a full grid of minutes per symbol, NULL where a minute has none.

    A symbol without any candle on the interval's dates has no grid. The grid is made between the candles of each
    (symbol, date), of which only the candles and one anchor a date are shuffled, and never the minutes.
    """
    begin = start.replace(second=0, microsecond=0)
    first = begin if begin == start else begin + timedelta(minutes=1)
    last = (end - timedelta(microseconds=1)).replace(second=0, microsecond=0)
    if last < first:
        return candles.where(F.lit(False))
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (first, last))
    t, minute, day = F.col("open_time"), F.expr("INTERVAL 1 MINUTE"), F.expr("INTERVAL 1 DAY")
    dated = candles.where(F.to_date(t).between(F.lit(start.date()), F.lit(end.date())))
    days = F.sequence(start_of_day(lo), start_of_day(hi), day)
    anchors = dated.select("symbol").distinct().withColumn("_day", F.explode(days))
    anchors = anchors.select("symbol", "_day", F.greatest(F.col("_day"), lo).alias("open_time"), F.lit(True).alias("_anchor"))
    placed = dated.where(F.col("symbol").isNotNull() & t.between(lo, hi) & (t == floor_time(t, 60)))
    line = placed.withColumns({"_day": start_of_day(t), "_anchor": F.lit(False)}).unionByName(anchors, allowMissingColumns=True)
    within = Window.partitionBy("symbol", "_day").orderBy("open_time", "_anchor")
    stop = F.coalesce(F.lead("open_time").over(within), F.least(F.col("_day") + day, hi + minute))
    held = F.col("_anchor") & F.lag("open_time").over(within).eqNullSafe(t)  # a candle has this minute already
    spans = line.withColumns({"_stop": stop, "_from": F.when(held, t + minute).otherwise(t)})
    # Candles of one minute follow each other without a gap, and each of them keeps its row.
    upto = F.greatest(F.col("_stop") - minute, F.when(F.col("_anchor"), F.col("_from") - minute).otherwise(t))
    minutes = F.when(F.col("_from") <= upto, F.sequence("_from", upto, minute))
    values = [c for c in candles.columns if c not in ("symbol", "open_time")]
    full = spans.select("symbol", *values, t.alias("_at"), "_anchor", F.explode(minutes).alias("open_time"))
    own = (F.col("_at") == t) & ~F.col("_anchor")
    return full.select("symbol", "open_time", *[F.when(own, F.col(c)).alias(c) for c in values])


def vwap_rates(candles: DataFrame, order: str = "position") -> DataFrame:
    """(symbol, minute, rate): quote volume over volume, the close where nothing traded; last duplicate wins."""
    typed = coerce_numeric(candles, ["volume", "quote_asset_volume", "close_price"], ["open_time"])
    rate = F.when(F.col("volume") > 0, F.try_divide("quote_asset_volume", "volume")).otherwise(F.col("close_price"))
    priced = typed.select("symbol", F.col("open_time").alias("minute"), rate.alias("rate"), order)
    return deduplicate(priced, ["symbol", "minute"], order).drop(order)


def candles_from_ticks(ticks: DataFrame, duration: str = "1 minute") -> DataFrame:
    """Full candles straight from stored fills, for symbols without candle archives."""
    slot = F.window("trade_time", duration).getField("start").alias("open_time")
    quote = F.col("price") * F.col("quantity")
    taker_buy = ~F.col("is_buyer_maker")
    at = F.struct("trade_time", "trade_id")
    return ticks.groupBy("symbol", slot).agg(
        F.min_by("price", at).alias("open_price"),
        F.max_by("price", at).alias("close_price"),
        F.sum("quantity").alias("volume"),
        F.sum(quote).alias("quote_asset_volume"),
        F.sum(F.when(taker_buy, quote).otherwise(0.0)).alias("taker_buy_quote_asset_volume"),
        F.max("trade_id").alias("position"),
    )

