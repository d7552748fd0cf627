"""Shared pieces of the registered queries: staged bars on the Spark side, CTEs on the SQL side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.operators.clean import fill_missing
from barspark.operators.resample import ohlcv_grid
from barspark.operators.series import BARS, Series, stage

EVENT_TICKS = Series(tie=("event_id",))
ORDER_TICKS = Series(tie=("o_orderkey",))
_staged: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
                    F.col("value").alias("price"))


def order_ticks(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey",
                    F.col("o_totalprice").alias("price"))


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Build and stage a table once per session, as the raw bar files are for later steps."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _staged:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        _staged[key] = stage(build())
    return _staged[key]


def forget() -> None:
    """Let the next query build what it needs anew."""
    _staged.clear()


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars per event type on a full grid, empty hours null."""
    return _once(spark, sf, "gappy", lambda: ohlcv_grid(event_ticks(spark, sf), "1 hour", s=EVENT_TICKS))


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "bars", lambda: fill_missing(gappy(spark, sf), "ffill", BARS))


def day_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per order priority, filled."""
    return _once(spark, sf, "day_bars", lambda: fill_missing(
        ohlcv_grid(order_ticks(spark, sf), "1 day", s=ORDER_TICKS), "ffill", BARS))


def show(df: DataFrame, digits: int = 6, **exact: int) -> DataFrame:
    """Doubles rounded (and -0 made 0), time stamps without zone: comparable with the SQL side."""
    def one(f) -> Column:
        c = F.col(f"`{f.name}`")
        t = f.dataType.typeName()
        if t in ("double", "float"):
            return (F.round(c, exact.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if t == "timestamp":
            return c.cast("timestamp_ntz").alias(f.name)
        if t in ("integer", "short", "byte"):
            return c.cast("long").alias(f.name)
        return c
    return df.select(*[one(f) for f in df.schema.fields])


# ---------------------------------------------------------------- SQL


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


HOUR, DAY = 3_600_000_000, 86_400_000_000
W = "PARTITION BY symbol ORDER BY pos"


def over(n: int, part: str = W) -> str:
    return f"OVER ({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, c: str, n: int, part: str = W) -> str:
    return f"CASE WHEN count({c}) {over(n, part)} = {n} THEN {agg}({c}) {over(n, part)} END"


def ffill(c: str, part: str = W) -> str:
    return f"last_value({c} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def bfill(c: str, part: str = W) -> str:
    return f"first_value({c} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _grid(name: str, src: str, sym: str, ts: str, price: str, tie: str, us: int) -> str:
    return f"""{name} AS MATERIALIZED (
  WITH t AS (SELECT {sym} AS symbol, epoch_us({ts}) // {us} AS bin, {ts} AS ts0, {tie} AS tie, {price} AS price FROM {src}),
  a AS (SELECT symbol, bin, first(price ORDER BY ts0, tie) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts0, tie) AS close, count(price)::DOUBLE AS volume FROM t GROUP BY symbol, bin),
  b AS (SELECT symbol, min(bin) AS b0, max(bin) AS b1 FROM t GROUP BY symbol),
  g AS (SELECT symbol, b0, unnest(generate_series(b0, b1)) AS bin FROM b)
  SELECT g.symbol, make_timestamp(g.bin * {us}) AS ts, g.bin - g.b0 AS pos, a.open, a.high, a.low, a.close,
         coalesce(a.volume, 0.0) AS volume
  FROM g LEFT JOIN a ON a.symbol = g.symbol AND a.bin = g.bin)"""


def _filled(name: str, src: str) -> str:
    cols = ", ".join(f"coalesce({ffill(c)}, {bfill(c)}) AS {c}" for c in ("open", "high", "low", "close"))
    return f"{name} AS MATERIALIZED (SELECT symbol, ts, pos, {cols}, volume FROM {src})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "gappy": ((), _grid("gappy", "events", "event_type", "ts", "value", "event_id", HOUR)),
    "bars": (("gappy",), _filled("bars", "gappy")),
    "gappy_days": ((), _grid("gappy_days", "orders", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey", DAY)),
    "day_bars": (("gappy_days",), _filled("day_bars", "gappy_days")),
}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTES[name] = (needs, f"{name} AS MATERIALIZED ({sql})" if not sql.lstrip().startswith(f"{name}(") else sql)


def sql(*names: str, select: str) -> str:
    """``select`` preceded by the named CTEs and all they need."""
    done: list[str] = []

    def add(n: str) -> None:
        if n not in done:
            for d in CTES[n][0]:
                add(d)
            done.append(n)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(CTES[n][1] for n in done) + "\n" if done else "") + select
