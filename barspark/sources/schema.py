"""Explicit schemas (DDL strings): bars, vendor prices, live messages, events of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: kinds of signals, orders and prices, rounding of vendor prices
SIGNAL_TYPES = ["BUY", "SELL", "EXIT_LONG", "EXIT_SHORT", "INCREASE_LONG", "INCREASE_SHORT", "DECREASE_LONG", "DECREASE_SHORT", "REVERSE"]
ORDER_TYPES = ["MARKET", "LIMIT", "STOP", "STOP_LIMIT", "TRAILING_STOP"]
ORDER_SIDES = ["BUY", "SELL"]
PRICE_DECIMALS = 5
# ---- end of fixed values

BAR_CSV = "Date string, Open string, High string, Low string, Close string, Volume string"
BARS = "symbol string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
_QUOTE = "struct<bid: double, ask: double>"
VENDOR_PRICES = (
    f"instrument string, resolution string, prices array<struct<snapshotTimeUTC: string, openPrice: {_QUOTE}, highPrice: {_QUOTE}, "
    f"lowPrice: {_QUOTE}, closePrice: {_QUOTE}, lastTradedVolume: double>>")
MESSAGE = (
    "destination string, payload struct<epic: string, resolution: string, type: string, priceType: string, t: bigint, o: double, h: double, l: double, c: double>")
SIGNALS = "ts timestamp, symbol string, signal_type string, strength double, strategy_id string, reason string, metadata map<string, string>"
ORDERS = "ts timestamp, symbol string, order_type string, order_side string, quantity double, price double, order_id string"
FILLS = "ts timestamp, symbol string, order_side string, quantity double, fill_price double, commission double, order_id string, fill_id string"


def known_kind(c: str | Column, kinds: list[str]) -> Column:
    """Rows whose value is one of the enumerated kinds."""
    return (F.col(c) if isinstance(c, str) else c).isin(kinds)
