"""Reading bars and vendor files, writing tables of bars, features, runs and records."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barspark.functions.columns import number, stamp
from barspark.functions.naming import dataset_columns, find_price_columns, find_time_column
from barspark.operators.resample import last_rows
from barspark.operators.series import BARS, Series
from barspark.sources.schema import PRICE_DECIMALS, VENDOR_PRICES


# ---------------------------------------------------------------- reading


def headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """Header line to the files that begin with it; each file once, however many of the paths match it.

    A pass over the text: a task keeps the first line of each file whose beginning it reads. The driver gets the list of files.
    """
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value"))
    text = text.where("start = 0")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            names = b.column(0).to_pylist()
            new = [i for i, n in enumerate(names) if n not in seen and not seen.add(n)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new, pa.int64())), b.column(2).take(pa.array(new, pa.int64()))], ["path", "header"])

    out: dict[str, list[str]] = {}
    for r in text.mapInArrow(first, "path string, header string").distinct().orderBy("path").collect():
        out.setdefault(r["header"].lstrip("\ufeff"), []).append(unquote(r["path"]))
    return out


def read_bars_csv(spark: SparkSession, paths: str | Sequence[str], date_col: str = "Date", date_format: str | None = None,
                  symbol: str | None = None, symbols: Sequence[str] = ()) -> DataFrame:
    """Bar files with a header; symbol and timeframe from the file names.

    Columns are read as text by name (files may hold them in any order or add others) and parsed
    tolerantly: files are read in groups of equal headers, since a reader takes one header for all its files. Without
    ``date_col`` the first column that looks like a time is used. ``symbols``: a file whose parsed symbol
    is none of them has the longest one that its name contains.
    """
    out = None
    groups: dict[tuple, list[str]] = {}
    for header, files in headers(spark, paths).items():
        for f in files:
            groups.setdefault((header, tuple(re.findall(r"/([^/=]+)=[^/]*(?=/)", f))), []).append(f)
    for files in groups.values():
        part = _read_alike(spark, files, date_col, date_format, symbol, symbols)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("the bar files are empty")
    return out


def _read_alike(spark: SparkSession, files: list[str], date_col: str, date_format: str | None, symbol: str | None, symbols: Sequence[str]) -> DataFrame:
    reader = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
    parted = re.match(r"(.*?)/[^/=]+=[^/]*/", files[0])  # folders named column=value
    raw = (reader.option("basePath", parted[1]) if parted else reader).csv(files)
    when = date_col if date_col in raw.columns else find_time_column(raw.columns)
    if when is None:
        raise ValueError("no date column in the bar files")
    path = F.col("_metadata.file_path")
    name = dataset_columns(path)
    price = find_price_columns(raw.columns)
    part = F.col("symbol") if "symbol" in raw.columns else name["symbol"]
    if symbols:
        file = F.element_at(F.split(path, "/"), -1)
        held = [F.when(F.contains(file, F.lit(s)), F.lit(s)) for s in sorted(symbols, key=lambda s: (-len(s), s))]
        part = F.when(part.isin(list(symbols)), part).otherwise(F.coalesce(*held, part))
    known = F.lit(symbol) if symbol else part
    return raw.select(
        known.alias("symbol"), name["timeframe"].alias("timeframe"), stamp(when, date_format).alias("ts"),
        *[number(price[c]).alias(c) if price[c] else F.lit(None).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")],
        *[F.col(c) for c in raw.columns if c not in (when, "symbol") and c not in price.values()])


def read_symbols(spark: SparkSession, folder: str, symbols: Sequence[str], date_format: str | None = None, extension: str = "csv") -> DataFrame:
    """The files of the given symbols in a folder; one path pattern per symbol, every matching file once."""
    paths = [f"{folder}/*{s}*.{extension}" for s in symbols]
    return read_bars_csv(spark, paths, date_format=date_format, symbols=symbols)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet", symbols: Sequence[str] | None = None,
                   schema: StructType | None = None) -> DataFrame:
    """A processed table; with ``symbols`` only their partitions are read."""
    if fmt == "csv":
        df = read_bars_csv(spark, path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).format(fmt).load(path)
    return df.where(F.col("symbol").isin(list(symbols))) if symbols else df


def midpoints(prices: DataFrame, decimals: int | None = PRICE_DECIMALS) -> DataFrame:
    """Vendor price documents to bars: (bid + ask) / 2, rounded unless ``decimals`` is None."""
    p = prices.select(F.col("instrument").alias("symbol"), F.col("resolution").alias("timeframe"), F.inline("prices"))

    def mid(c: str):
        m = (F.col(f"{c}.bid") + F.col(f"{c}.ask")) / 2
        return m if decimals is None else F.round(m, decimals)

    return p.select("symbol", "timeframe", F.try_to_timestamp("snapshotTimeUTC").alias("ts"), mid("openPrice").alias("open"), mid("highPrice").alias("high"),
                    mid("lowPrice").alias("low"), mid("closePrice").alias("close"), F.col("lastTradedVolume").alias("volume"))


def read_vendor_json(spark: SparkSession, path: str | Sequence[str], decimals: int | None = PRICE_DECIMALS, multi_line: bool = True) -> DataFrame:
    return midpoints(spark.read.schema(VENDOR_PRICES).option("multiLine", multi_line).json(path), decimals)


def warm_up_bars(prices: DataFrame, n: int = 250, s: Series = BARS) -> DataFrame:
    """Latest ``n`` unrounded midpoint bars per symbol with raw and original copies, to seed a stream."""
    bars = last_rows(midpoints(prices, None), n, s)
    return bars.withColumns({f"{c}_{k}": F.col(c) for c in ("open", "high", "low", "close") for k in ("raw", "original")})


# ---------------------------------------------------------------- writing


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ("symbol",)) -> None:
    writer = df.write.mode(mode).partitionBy(*by).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


FEATURE_KEYS = ("symbol", "timeframe", "feature_set")


def save_features(df: DataFrame, path: str, feature_set: str, timeframe: str) -> None:
    """Partitioned by symbol, timeframe and set; only the partitions written are replaced."""
    out = df.withColumns({"timeframe": F.lit(timeframe), "feature_set": F.lit(feature_set)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*FEATURE_KEYS).parquet(path)


def load_features(spark: SparkSession, path: str, feature_set: str, timeframe: str, symbols: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path).where((F.col("feature_set") == feature_set) & (F.col("timeframe") == timeframe))
    return df.where(F.col("symbol").isin(list(symbols))) if symbols else df


RUN_TABLES = ("equity", "trades", "metrics", "parameters")


def save_run(path: str, run_id: str, **tables: DataFrame) -> None:
    """Equity, trades, metrics and parameters of a run, each a table partitioned by run."""
    for name, df in tables.items():
        if name not in RUN_TABLES:
            raise ValueError(f"unknown run table {name!r}")
        out = df.withColumn("run_id", F.lit(run_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def load_run(spark: SparkSession, path: str, run_id: str, names: Sequence[str] = RUN_TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").where(F.col("run_id") == run_id) for n in names}


def append_records(df: DataFrame, path: str, kind: str) -> None:
    """Trades, orders or metrics as JSON lines in an append-only table per kind."""
    df.select(F.lit(kind).alias("kind"), F.current_timestamp().alias("logged_at"), F.to_json(F.struct("*")).alias("record")).write.mode("append").partitionBy("kind").json(path)


def read_records(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    lines = spark.read.schema("kind string, logged_at timestamp, record string").json(path).where(F.col("kind") == kind)
    return lines.select("logged_at", F.from_json("record", schema).alias("r")).select("logged_at", "r.*")


def save_selection(spark: SparkSession, path: str, features: Sequence[str], metadata: DataFrame | None = None, cv: DataFrame | None = None) -> None:
    """Selected feature names in order, feature metadata and cross-validation results as tables."""
    spark.createDataFrame(list(enumerate(features)), "rank int, feature string").write.mode("overwrite").parquet(f"{path}/selected_features")
    if metadata is not None:
        metadata.write.mode("overwrite").parquet(f"{path}/feature_meta")
    if cv is not None:
        cv.write.mode("overwrite").parquet(f"{path}/cv_results")
