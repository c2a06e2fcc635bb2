"""Trade tick archives and the partitioned tick store."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickspark.names import MICROSECONDS_SINCE, SPOT_TRADE_COLUMNS

RAW_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("raw_time", T.LongType()),
        T.StructField("is_buyer_maker", T.BooleanType()),
    ]
)
STORED_COLUMNS = ["trade_id", "price", "quantity", "trade_time", "is_buyer_maker"]
_CHUNK_ROWS = 1_000_000
#: Unzipped files up to this size are parsed together until they reach it.
_SMALL_BYTES = 4 << 20
_NAME = r"([^/]+)/[^/]*@(\d{4}-\d{2}-\d{2})\.zip$"


def list_archives(spark: SparkSession, root: str, start: datetime, end: datetime) -> DataFrame:
    """Archives ``<symbol>/…@YYYY-MM-DD.zip`` whose date lies in the interval's days, both ends included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return archives_between(files.load(root), start, end)


def archives_between(files: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Parse symbol and date from ``path`` and keep the dates inside the bounds."""
    named = files.withColumns(
        {
            "symbol": F.regexp_extract("path", _NAME, 1),
            "date": F.try_to_date(F.regexp_extract("path", _NAME, 2)),
        }
    )
    return named.where(F.col("date").between(F.lit(start.date()), F.lit(end.date())))


def parse_archives(archives: DataFrame, names: Sequence[str] = tuple(SPOT_TRADE_COLUMNS)) -> DataFrame:
    """Unzip headerless CSV archives (``path``, ``content``) into raw fills.

    Spark's CSV reader cannot open zip files, so each archive is unzipped in the task that reads it. Small files are
    parsed many at a time, large ones in chunks, which bounds a task's memory by one compressed archive plus one chunk.
    """
    wanted = ["trade_id", "price", "quantity", "trade_time", "is_buyer_maker"]
    options = {"header": None, "names": list(names), "usecols": wanted, "float_precision": "round_trip"}

    def raw(rows: pd.DataFrame, path) -> pd.DataFrame:
        return rows.rename(columns={"trade_time": "raw_time"}).assign(path=path)[RAW_SCHEMA.names]

    def together(held: list[tuple[str, bytes]]) -> Iterator[pd.DataFrame]:
        held = [(path, text if text.endswith(b"\n") else text + b"\n") for path, text in held if text.strip()]
        if not held:
            return
        counts = [text.count(b"\n") for _, text in held]
        rows = pd.read_csv(io.BytesIO(b"".join(text for _, text in held)), **options)
        if len(rows) == sum(counts):
            yield raw(rows, [path for (path, _), n in zip(held, counts) for _ in range(n)])
        else:  # blank lines: rows can't be counted ahead
            yield from (raw(pd.read_csv(io.BytesIO(text), **options), path) for path, text in held)

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.infolist():
                        if member.file_size <= _SMALL_BYTES:
                            held.append((path, archive.read(member)))
                            size += member.file_size
                            if size > _SMALL_BYTES:
                                yield from together(held)
                                held, size = [], 0
                            continue
                        with archive.open(member) as stream:
                            for chunk in pd.read_csv(stream, chunksize=_CHUNK_ROWS, **options):
                                yield raw(chunk, path)
        yield from together(held)

    return archives.select("path", "content").mapInPandas(unzip, RAW_SCHEMA)


def normalise_time(raw: Column, day: Column) -> Column:
    """Epoch milliseconds before 2025, microseconds from then on, as a time without zone."""
    micros = F.when(day < F.lit(MICROSECONDS_SINCE.date()), raw * 1000).otherwise(raw)
    return F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    )


def ingest(archives: DataFrame) -> DataFrame:
    """Archives to stored fills with their date and symbol."""
    raw = parse_archives(archives)
    placed = raw.withColumns(
        {"symbol": F.regexp_extract("path", _NAME, 1), "date": F.to_date(F.regexp_extract("path", _NAME, 2))}
    )
    return placed.withColumn("trade_time", normalise_time(F.col("raw_time"), F.col("date"))).select(
        *STORED_COLUMNS, "date", "symbol"
    )


def write_ticks(
    ticks: DataFrame, path: str, partitions: Sequence[str] = ("date", "symbol"), compression: str = "gzip"
) -> None:
    """Write fills by partition; a re-run replaces just the partitions it holds.

    ``rebalance`` lets the adaptive planner split a dominant (date, symbol) over several files and
    pack small ones together. With ``partitions=("date",)`` symbols are sorted inside files instead
    of split into directories, and a symbol filter prunes by row-group statistics.
    """
    laid_out = ticks if "date" in ticks.columns else ticks.withColumn("date", F.to_date("trade_time"))
    rest = [c for c in ("symbol",) if c not in partitions]
    (
        laid_out.select(*STORED_COLUMNS, "date", "symbol")
        .hint("rebalance", *[F.col(p) for p in partitions])
        .sortWithinPartitions(*partitions, *rest, "trade_time", "trade_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", compression)
        .partitionBy(*partitions)
        .parquet(path)
    )


def scan_ticks(spark: SparkSession, path: str) -> DataFrame:
    fields = ", ".join(
        ["trade_id BIGINT, price DOUBLE, quantity DOUBLE, trade_time TIMESTAMP_NTZ", "is_buyer_maker BOOLEAN"]
        + ["date DATE", "symbol STRING"]
    )
    return spark.read.schema(fields).parquet(path)


def ticks_between(
    ticks: DataFrame, symbol: str | Sequence[str], start: datetime, end: datetime, closed: bool = True
) -> DataFrame:
    """Fills of one or several symbols in [start, end], or in [start, end) with ``closed=False``.

    The date bounds are implied by the time bounds but prune partitions.
    """
    symbols = [symbol] if isinstance(symbol, str) else list(symbol)
    t, lo, hi = F.col("trade_time"), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = (t >= lo) & ((t <= hi) if closed else (t < hi))
    on_days = F.col("date").between(F.lit(start.date()), F.lit(end.date()))
    return ticks.where(F.col("symbol").isin(symbols) & on_days & inside)


def trades_between(ticks: DataFrame, symbol: str | Sequence[str], start: datetime, end: datetime) -> DataFrame:
    """The portfolio's view of fills: half-open interval, four columns and the tie-breaker."""
    found = ticks_between(ticks, symbol, start, end, closed=False)
    return found.select("symbol", "trade_time", "price", "quantity", "is_buyer_maker", "trade_id")


def price_series(ticks: DataFrame, symbol: str | Sequence[str], start: datetime, end: datetime) -> DataFrame:
    return trades_between(ticks, symbol, start, end).select("symbol", "trade_time", "price", "trade_id")


def _symbols_by_dates(
    ticks: DataFrame, events: DataFrame, start: Column, end: Column, quote_asset: str | None
) -> tuple[DataFrame, DataFrame]:
    """The distinct symbols of each set of dates, and the set of dates of each event.

    (date, symbol) pairs are deduplicated before they meet the events, so fills are reduced where
    they are read; on a store partitioned by both columns only directory names are read. Symbols are made distinct
    once for each set of dates, of which there are far fewer than events.
    """
    pairs = ticks.select("date", "symbol").distinct()
    if quote_asset is not None:
        pairs = pairs.where(F.col("symbol").endswith(f"-{quote_asset}"))
    days = F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))
    dated = events.select("pump_hash", F.explode(days).alias("date")).groupBy("pump_hash")
    dated = dated.agg(F.sort_array(F.collect_set("date")).alias("dates"))
    spans = dated.select("dates").distinct()
    return spans.withColumn("date", F.explode("dates")).join(pairs, "date").select("dates", "symbol").distinct(), dated


def active_symbols(ticks: DataFrame, events: DataFrame, start: Column, end: Column, quote_asset: str | None = "BTC") -> DataFrame:
    """Symbols with data on any date of each event's interval, limited to pairs quoted in ``quote_asset``."""
    seen, dated = _symbols_by_dates(ticks, events, start, end, quote_asset)
    return seen.join(dated, "dates").select("pump_hash", "symbol")


def universe_sizes(ticks: DataFrame, events: DataFrame, start: Column, end: Column, quote_asset: str | None = "BTC") -> DataFrame:
    """Number, first and last of each event's :func:`active_symbols`, without a row for each of them.

    Events of the same dates have the same symbols, so these are counted once for each set of dates.
    """
    seen, dated = _symbols_by_dates(ticks, events, start, end, quote_asset)
    counted = seen.groupBy("dates").agg(
        F.count("*").alias("symbols"), F.min("symbol").alias("first_symbol"), F.max("symbol").alias("last_symbol")
    )
    return counted.join(dated, "dates").select("pump_hash", "symbols", "first_symbol", "last_symbol")


def first_date(ticks: DataFrame) -> DataFrame:
    """Earliest stored date."""
    return ticks.agg(F.min("date").alias("first_date"))
