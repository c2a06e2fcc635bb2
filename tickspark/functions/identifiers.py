"""Symbols and event identifiers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickspark.names import DEFAULT_EXCHANGE

_ID_TIME_FORMAT = "yyyy-MM-dd'T'HH-mm-ss"


def base_asset(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit("-"), F.lit(1))


def term_asset(symbol: Column) -> Column:
    return F.split_part(symbol, F.lit("-"), F.lit(2))


def exchange_symbol(symbol: Column) -> Column:
    """``ADA-USDT`` as the exchange writes it: ``ADAUSDT``."""
    return F.concat(base_asset(symbol), term_asset(symbol))


def event_hash(symbol: Column, event_time: Column, exchange: str | Column = DEFAULT_EXCHANGE) -> Column:
    """``SYMBOL:EXCHANGE:time`` with second resolution, the identity of an event."""
    venue = F.lit(exchange) if isinstance(exchange, str) else exchange
    return F.concat_ws(":", symbol, venue, F.date_format(event_time, _ID_TIME_FORMAT))


def event_symbol(hash_: Column) -> Column:
    return F.split_part(hash_, F.lit(":"), F.lit(1))


def event_exchange(hash_: Column) -> Column:
    return F.upper(F.split_part(hash_, F.lit(":"), F.lit(2)))


def event_time(hash_: Column) -> Column:
    return F.to_timestamp_ntz(F.split_part(hash_, F.lit(":"), F.lit(3)), F.lit(_ID_TIME_FORMAT))


def duration_slug(duration: timedelta) -> str:
    """``250MS`` below a second, ``30S`` from one second up."""
    seconds = duration.total_seconds()
    if seconds < 1:
        return f"{int(seconds * 1000)}MS"
    if seconds % 1:
        raise ValueError("durations of a second or more must be whole seconds")
    return f"{int(seconds)}S"


def duration_slug_column(milliseconds: Column) -> Column:
    """:func:`duration_slug` for a column of whole milliseconds."""
    below = F.concat(milliseconds.cast("bigint").cast("string"), F.lit("MS"))
    above = F.concat(F.floor(milliseconds / 1000).cast("string"), F.lit("S"))
    return F.when(milliseconds < 1000, below).otherwise(above)
