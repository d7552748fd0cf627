"""Column and dataset names: lookup, categories, file names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: feature classes by window length, matched exactly first, then as patterns
FEATURE_RULES: dict[str, list[str]] = {
    "price": ["open", "high", "low", "close"],
    "volume": ["volume"],
    "short_window": ["sma_5", "sma_10", "ema_5", "ema_10", "roc_1", "roc_5"],
    "medium_window": ["sma_20", "ema_20", "rsi_14", "macd", "stoch_k", "stoch_d", "atr_14", "volatility_5",
                      "volatility_10"],
    "long_window": ["sma_50", "sma_200", "ema_50", "ema_200", "volatility_20", "volatility_30"],
    "categorical": ["day_of_week", "hour_of_day", "month", "quarter", "asian_session", "european_session",
                    "us_session", "day_"],
    "returns": ["_return", "pct_change"],
}
# ---- fixed values: report categories, the first matching pattern wins
PRICE_WORDS = "open|high|low|close"
IMPORTANCE_CATEGORIES: list[tuple[str, str]] = [
    ("original", "Raw Price"),
    (f"(?=.*({PRICE_WORDS}))(?=.*(return|log|pct))", "Transformed Price"),
    (PRICE_WORDS, "Price Other"),
    ("volume", "Volume"),
    ("sma|ema", "Moving Averages"),
    ("rsi|macd|stoch", "Oscillators"),
    ("atr|volatility", "Volatility"),
    ("doji|hammer|engulfing", "Patterns"),
    ("day|hour|month|session", "Time"),
]
METADATA_CATEGORIES: list[tuple[str, str]] = [
    (f"(?=.*({PRICE_WORDS}))(?=.*(return|log|pct))", "transformed_price"),
    (PRICE_WORDS, "raw_price"),
    ("volume", "volume"),
    ("sma|ema|rsi|macd|bollinger|stoch", "technical"),
    ("atr|volatility", "volatility"),
    ("doji|hammer|engulfing|support|resistance", "patterns"),
    ("day|hour|month|session", "time"),
]
DATASET_NAME = r"(raw|processed|meta)_([A-Z]+)_([a-z0-9]+)_(\d+)_(\d+)(?:\.[^/]*)?$"
# ---- end of fixed values


def find_price_columns(columns: Iterable[str]) -> dict[str, str | None]:
    """open/high/low/close/volume by exact (case-free) name, else the first column containing it."""
    names = list(columns)
    found: dict[str, str | None] = {}
    for want in ("open", "high", "low", "close", "volume"):
        exact = [c for c in names if c.lower() == want]
        partial = [c for c in names if want in c.lower()]
        found[want] = (exact or partial or [None])[0]
    return found


def find_time_column(columns: Iterable[str]) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in ("date", "time", "timestamp"))), None)


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def restore_names(df: DataFrame, original: Iterable[str]) -> DataFrame:
    """Give columns back the spelling they had in ``original``; new columns stay lower case."""
    return df.withColumnsRenamed({c.lower(): c for c in original if c.lower() != c})


def price_of(df: DataFrame) -> Column:
    """First usable price per row: ``close_raw``, ``close_original``, ``close``; null when not positive."""
    present = {c.lower(): c for c in df.columns}
    cols = [F.col(present[c]) for c in ("close_raw", "close_original", "close") if c in present]
    if not cols:
        raise ValueError("no close price column")
    first = F.coalesce(*cols)
    return F.when(first > 0, first)


def price_return_target(df: DataFrame, target: str) -> str | None:
    """The named target column, else the first column with ``return`` in its name."""
    if target in df.columns:
        return target
    return next((c for c in df.columns if "return" in c.lower()), None)


def categorise(columns: Iterable[str], rules: Mapping[str, Sequence[str]] | None = None) -> dict[str, str]:
    """Class of every column by ``rules``: an exact name first, then patterns in rule order.

    A pattern with an underscore is a prefix or a substring, one without is a substring.
    """
    rules = rules or FEATURE_RULES
    exact = {name: cls for cls, names in reversed(list(rules.items())) for name in names}

    def by_pattern(c: str) -> str:
        return next((cls for cls, pats in rules.items() if any(p in c for p in pats)), "other")

    return {c: exact.get(c.lower()) or by_pattern(c.lower()) for c in columns}


def category_column(name: Column, table: list[tuple[str, str]], default: str | None = "Other") -> Column:
    low = F.lower(name)
    out = F.lit(default)
    for pattern, label in reversed(table):
        out = F.when(low.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def dataset_columns(path: Column) -> dict[str, Column]:
    """symbol, timeframe, dates and kind encoded in a file name, null where it has another form."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(path, DATASET_NAME, i), F.lit(""))

    return {"kind": part(1), "symbol": part(2), "timeframe": part(3), "start_date": part(4), "end_date": part(5)}


def dataset_name(symbol: Column, timeframe: Column, start: Column, end: Column, kind: str = "raw",
                 source: str | None = None, info: str | None = None, extension: str = "csv") -> Column:
    """``kind_SYMBOL_tf_start_end.ext`` as a column, names made safe and dates as yyyyMMdd."""
    def safe(c: Column) -> Column:
        return F.regexp_replace(c, r"[^\w]", "_")

    tf = F.lower(timeframe)
    for word, letter in (("minute", "m"), ("hour", "h"), ("day", "d"), ("_", "")):
        tf = F.replace(tf, F.lit(word), F.lit(letter))
    prefix = [F.lit(kind)] + ([safe(F.lit(info))] if info and kind == "processed" else [])
    parts = [*prefix, safe(symbol), tf, F.date_format(start, "yyyyMMdd"), F.date_format(end, "yyyyMMdd")]
    parts += [safe(F.lit(source))] if source else []
    return F.concat(F.concat_ws("_", *parts), F.lit(f".{extension}"))


def derived_name(path: Column, file_type: str, extension: str = "csv") -> Column:
    """Name of a file derived from a processed file (importance, performance ...)."""
    m = dataset_columns(path)
    known = F.concat_ws("_", F.lit(file_type), m["symbol"], m["timeframe"], m["start_date"], m["end_date"])
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.when(m["symbol"].isNotNull(), known).otherwise(F.concat_ws("_", F.lit(file_type), stem)),
                    F.lit(f".{extension}"))
