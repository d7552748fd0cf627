"""Queries of their own for operators that others use only in passing: files, naming, selection rules, models on disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from barspark.functions import naming as N
from barspark.operators import ledger, models, select, splits
from barspark.sources import files
from checks.common import R, bars, gappy, show, sql, table
from checks.stream_queries import _folder
from checks.trading_queries import signalled

Q: dict = {}
S: dict[str, str] = {}


def q(name: str, fn, text: str, *ctes: str) -> None:
    Q[name] = fn
    S[name] = sql(*ctes, select=text)


def values(rows: list[tuple], names: str) -> str:
    show_ = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show_, r)) + ')' for r in rows)}) t({names})"


_PX = ", ".join(f"{R(c)} AS {c}" for c in ("open", "high", "low", "close"))

# ---------------------------------------------------------------- files


def _processed(sp, sf):
    where = _folder(sp)
    files.write_bars(bars(sp, sf), where)
    return show(files.read_processed(sp, where, symbols=["click", "view"]).select("symbol", "ts", "open", "high", "low", "close", "volume"))


q("read_processed", _processed, f"SELECT symbol, ts, {_PX}, volume FROM bars WHERE symbol IN ('click', 'view')", "bars")


def _warm(sp, sf):
    quote = lambda c: F.struct((F.col(c) - 0.01).alias("bid"), (F.col(c) + 0.02).alias("ask"))
    one = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("snapshotTimeUTC"), quote("open").alias("openPrice"), quote("high").alias("highPrice"),
                   quote("low").alias("lowPrice"), quote("close").alias("closePrice"), F.col("volume").cast("long").alias("lastTradedVolume"))
    docs = bars(sp, sf).select(F.col("symbol").alias("instrument"), F.lit("HOUR").alias("resolution"), F.array(one).alias("prices"))
    return show(files.warm_up_bars(docs, 100).select("symbol", "ts", "close", "close_raw", "open_original"))


q("warm_up_bars", _warm, f"""SELECT symbol, ts, {R('close + 0.005')} AS close, {R('close + 0.005')} AS close_raw, {R('open + 0.005')} AS open_original FROM bars
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) <= 100""", "bars")


def _run_bundle(sp, sf):
    where = _folder(sp)
    for run, low in (("a", 0), ("b", 300)):
        rows = bars(sp, sf).where(F.col("pos") >= low)
        files.save_run(where, run, equity=rows.select("symbol", "ts", "close"), metrics=rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")))
    files.save_run(where, "a", metrics=bars(sp, sf).groupBy("symbol").agg(F.max("pos").alias("n")))  # replaces one table of one run
    got = [files.load_run(sp, where, r, ("equity", "metrics")) for r in ("a", "b")]
    return got[0]["equity"].groupBy("symbol").count().join(got[0]["metrics"], "symbol").select("symbol", F.col("count").alias("rows_a"), F.col("n").alias("last_a")).join(
        got[1]["metrics"].select("symbol", F.col("n").alias("rows_b")), "symbol", "left").transform(show)


q("run_bundle", _run_bundle, "SELECT symbol, count(*) AS rows_a, max(pos) AS last_a, nullif(count(*) FILTER (pos >= 300), 0) AS rows_b FROM bars GROUP BY symbol", "bars")


def _selection(sp, sf):
    where = _folder(sp)
    files.save_selection(sp, where, ["close", "volume", "open"], select.feature_metadata(gappy(sp, sf)))
    return sp.read.parquet(f"{where}/selected_features").join(sp.read.parquet(f"{where}/feature_meta"), F.col("feature") == F.col("column")).select(F.col("rank").cast("long"), "feature", "category", "nan_count")


q("saved_selection", _selection, """SELECT r AS rank, f AS feature, c AS category, n AS nan_count FROM (SELECT 0 AS r, 'close' AS f, 'raw_price' AS c, count(*) - count(close) AS n FROM gappy
  UNION ALL SELECT 1, 'volume', 'volume', count(*) - count(volume) FROM gappy UNION ALL SELECT 2, 'open', 'raw_price', count(*) - count(open) FROM gappy)""", "gappy")


def _saved_model(sp, sf):
    where, names = _folder(sp), ["open", "high", "low"]
    x = bars(sp, sf).withColumn("label", (F.col("close") > F.col("open")).cast("double"))
    m = models.model_pipeline(names).fit(x)
    models.save_model(m, where, names, "label", run="one")
    again, features, target, meta = models.load_model(sp, where)
    a, b = (models.predict(k, x).select("symbol", "pos", F.col("prediction").alias(n)) for k, n in ((m, "p"), (again, "q")))
    return a.join(b, ["symbol", "pos"]).groupBy("symbol").agg(F.count_if(F.col("p") == F.col("q")).alias("same")).withColumns(
        {"features": F.lit(",".join(features)), "target": F.lit(target), "run": F.lit(meta["run"])})


q("saved_model", _saved_model, "SELECT symbol, count(*) AS same, 'open,high,low' AS features, 'label' AS target, 'one' AS run FROM bars GROUP BY symbol", "bars")

# ---------------------------------------------------------------- naming


def _named_columns(sp, sf):
    x = table(sp, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("My_Close_bid"), (F.col("o_totalprice") + 1).alias("HIGH"), F.col("o_totalprice").alias("high_old"))
    p = N.find_price_columns(x.columns)
    return x.select("o_orderkey", F.round(F.col(p["close"]), 2).alias("close"), F.round(F.col(p["high"]), 2).alias("high"), F.lit(p["volume"]).cast("string").alias("volume"))


q("price_columns", _named_columns, "SELECT o_orderkey, round(o_totalprice, 2) AS close, round(o_totalprice + 1, 2) AS high, CAST(NULL AS VARCHAR) AS volume FROM orders")
q("selected_columns", lambda sp, sf: show(select.apply_selection(bars(sp, sf), ["volume", "close", "missing", "ts"])), f"SELECT symbol, ts, volume, {R('close')} AS close FROM bars", "bars")
_KINDS = {"price": ["open", "close"], "short_window": ["sma_5", "roc_1"], "long_window": ["sma_", "ema_200"]}


def _categories(sp, sf):
    x = bars(sp, sf).select("symbol", *[F.col("close").alias(c) for c in ("open_raw", "sma_5", "SMA_200", "roc_1", "volume_x")])
    kinds = N.categorise([c for c in x.columns if c != "symbol"], _KINDS)
    long = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("class"), F.col(c).alias("v")) for c, k in kinds.items()])
    return x.select(F.inline(long)).groupBy("column", "class").agg(F.count("v").alias("n"))


q("column_categories", _categories, "SELECT c.column, c.class, count(close) AS n FROM bars, (VALUES ('open_raw', 'price'), ('sma_5', 'short_window'), ('SMA_200', 'long_window'), ('roc_1', 'short_window'), ('volume_x', 'other')) c(\"column\", class) GROUP BY 1, 2", "bars")

# ---------------------------------------------------------------- folds from mixed periods
q("folds_mixed_periods", lambda sp, sf: splits.time_folds(bars(sp, sf), "10D", 120).groupBy("split_index", "split_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("split_index").cast("long").alias("split_index"), "split_type", "n"),
  """, e AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, max(pos) + 1 AS n FROM bars), g AS (SELECT a, b, CAST(round((b - a) / (n - 1)) AS BIGINT) * 120 AS te, 864000000000 AS tr FROM e),
  f AS (SELECT i, a + i * te AS s, tr, te FROM g, range(0, 1000) t(i) WHERE a + i * te + tr + te <= b),
  x AS (SELECT i, CASE WHEN epoch_us(ts) < s + tr THEN 'train' ELSE 'test' END AS k FROM bars JOIN f ON epoch_us(ts) >= s AND epoch_us(ts) < s + tr + te)
  SELECT CAST(i AS BIGINT) AS split_index, k AS split_type, count(*) AS n FROM x WHERE i IN (SELECT i FROM x GROUP BY i HAVING count(DISTINCT k) = 2) GROUP BY 1, 2""", "bars")


def _every_row(sp, sf, n):
    """Row folds with step 1 over the first ``n`` rows of each symbol."""
    x = splits.tag_folds(bars(sp, sf), splits.rolling(None, None, n, 300, 100, 1))
    return x.groupBy("symbol", "pos", "split_type").agg(F.count(F.lit(1)).alias("n"), F.min("split_index").cast("long").alias("first"), F.max("split_index").cast("long").alias("last"))


def _all_rows(sp, sf):
    """Row folds with step 1 over the longest symbol: as many folds as rows, whatever the plan's size."""
    return _every_row(sp, sf, bars(sp, sf).agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0])


q("folds_every_row_whole", _all_rows, """SELECT symbol, pos, k AS split_type, count(*) AS n, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last FROM
  (SELECT symbol, pos, i, CASE WHEN pos < i + 300 THEN 'train' ELSE 'test' END AS k FROM bars JOIN (SELECT unnest(range(0, max(pos) - 398)) AS i FROM bars) ON pos >= i AND pos < i + 400) GROUP BY 1, 2, 3""", "bars")

# ---------------------------------------------------------------- features in use, selection rules
q("usable_features", lambda sp, sf: sp.createDataFrame([(c,) for c in select.usable_features(gappy(sp, sf).withColumns({"flat": F.lit(1.0), "range": F.col("pos") * 2.0}), "close")], "feature string"),
  "SELECT unnest(list_filter(['open', 'high', 'low', 'volume', 'range'], lambda c: c = 'range' OR (c = 'volume' AND v) OR (c NOT IN ('range', 'volume') AND k))) AS feature FROM (SELECT count(open) = count(*) AS k, min(volume) < max(volume) AS v FROM gappy)", "gappy")


def _shares(sp, sf):
    """Order priorities as features, their share of the orders as importance."""
    n = table(sp, sf, "orders").groupBy((F.col("o_orderkey") % 30).alias("k")).agg(F.sum("o_totalprice").alias("v"))
    total = n.agg(F.sum("v")).first()[0]
    return n.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), (F.col("v") / total).alias("importance"))


_RANKED = "(SELECT 'f' || (o_orderkey % 30) AS feature, sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders) AS importance FROM orders GROUP BY 1)"


def _rule(**kw):
    def run(sp, sf):
        chosen = select.select_features(_shares(sp, sf), select.Selection(**kw))
        return sp.createDataFrame(list(enumerate(chosen)), "rank long, feature string")
    return run


def _first(n: str) -> str:
    return f"SELECT rank, feature FROM (SELECT row_number() OVER (ORDER BY importance DESC, feature) - 1 AS rank, feature, importance, count(*) OVER () AS live, sum(importance) OVER (ORDER BY importance DESC, feature) AS run FROM {_RANKED}) {'QUALIFY' if 'OVER' in n else 'WHERE'} rank < {n}"


q("select_top_n", _rule(method="top_n", n=7), _first("7"))
q("select_threshold", _rule(method="threshold", threshold=0.034), _first("least(50, greatest(10, count(*) FILTER (importance >= 0.034) OVER ()))"))
q("select_cumulative", _rule(method="cumulative", threshold=0.8), _first("least(50, greatest(10, count(*) FILTER (run <= 0.8) OVER ()))"))
q("select_share", _rule(method="share", min_features=2), _first("greatest(2, live * 0.2)"))


def _kinds(sp, sf):
    """Parts as features of some categories, with essential columns and a target among the unimportant ones."""
    n = table(sp, sf, "lineitem").groupBy((F.col("l_partkey") % 60).alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    name = F.when(F.col("k") == 3, "open_raw").when(F.col("k") == 4, "Date").when(F.col("k") == 5, "close_return").when(F.col("k") == 6, "flat").otherwise(F.concat(F.lit("f"), F.col("k").cast("string")))
    kind = F.when(F.col("k") < 30, "big").when(F.col("k") < 45, "middle").when(F.col("k") < 55, "small").otherwise("rare")
    weight = F.when(F.col("k") == 6, 0.0).when(F.col("k") < 10, F.col("v") / 1e3).when(F.col("k") < 45, F.col("v")).otherwise(F.col("v") / 1e2)
    return n.select(name.alias("feature"), weight.alias("importance"), kind.alias("category"))


_KINDS_SQL = """k0 AS (SELECT l_partkey % 60 AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1), k1 AS (SELECT CASE k WHEN 3 THEN 'open_raw' WHEN 4 THEN 'Date' WHEN 5 THEN 'close_return' WHEN 6 THEN 'flat' ELSE 'f' || k END AS feature,
  CASE WHEN k = 6 THEN 0.0 WHEN k < 10 THEN v / 1e3 WHEN k < 45 THEN v ELSE v / 1e2 END AS importance, CASE WHEN k < 30 THEN 'big' WHEN k < 45 THEN 'middle' WHEN k < 55 THEN 'small' ELSE 'rare' END AS category FROM k0),
  rk AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS r FROM k1)"""


def _chosen(**kw):
    return lambda sp, sf: show(select.selection(_kinds(sp, sf), select.Selection(**kw)))


# places: the first 20 by importance, then essentials in their fixed order, then the target
q("select_essentials", _chosen(method="top_n", n=20), f"""WITH {_KINDS_SQL} SELECT feature, row_number() OVER (ORDER BY o) - 1 AS place, why FROM (
  SELECT feature, r AS o, 'leading' AS why FROM rk WHERE r <= 20 UNION ALL SELECT feature, CASE feature WHEN 'open_raw' THEN 100 ELSE 101 END, 'essential' FROM rk WHERE r > 20 AND feature IN ('open_raw', 'Date')
  UNION ALL SELECT feature, 200, 'target' FROM rk WHERE r > 20 AND feature = 'close_return')""")
q("select_without_target", _chosen(method="top_n", n=60, keep_target=False), f"WITH {_KINDS_SQL} SELECT feature, row_number() OVER (ORDER BY r) - 1 AS place, 'leading' AS why FROM rk WHERE importance > 1e-10 AND feature <> 'close_return'")
# 22 kept: the mean category has 5; small (0 kept, favoured) gets 5, rare (0 kept) gets 2
_BALANCE = f"""WITH {_KINDS_SQL}, c AS (SELECT *, r <= 20 OR feature IN ('open_raw', 'Date') AS old FROM rk), m AS (SELECT *, greatest(1, (SELECT count(*) FILTER (old) // count(DISTINCT category) FROM c)) AS mean,
    count(*) FILTER (old) OVER (PARTITION BY category) AS have, min(r) OVER (PARTITION BY category) AS f, row_number() OVER (PARTITION BY category, old ORDER BY r) AS nth FROM c),
  z AS (SELECT feature, CASE WHEN r <= 20 THEN 'leading' WHEN old THEN 'essential' ELSE 'balance' END AS why, CASE WHEN r <= 20 THEN r WHEN feature = 'open_raw' THEN 100 WHEN feature = 'Date' THEN 101 ELSE 1000 + f * 100 + r END AS o, old
    FROM m WHERE old OR (have < mean AND nth <= CASE WHEN category = 'small' THEN mean ELSE greatest(1, mean // 2) END)),
  y AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY o) AS nth, count(*) FILTER (old) OVER () AS n_old, count(*) OVER () AS n FROM z),
  t AS (SELECT feature, why, o FROM y WHERE n <= {{most}} OR CASE WHEN old THEN nth <= {{most}} * n_old // n ELSE nth <= {{most}} - {{most}} * n_old // n END)
  SELECT feature, row_number() OVER (ORDER BY o) - 1 AS place, why FROM (SELECT * FROM t WHERE feature <> 'flat' UNION ALL SELECT 'close_return', 'target', 100000 WHERE 'close_return' NOT IN (SELECT feature FROM t))"""
q("select_balanced", _chosen(method="top_n", n=20, balance=True, favoured=("small",)), _BALANCE.format(most=50))
q("select_balanced_capped", _chosen(method="top_n", n=20, balance=True, favoured=("small",), max_features=24), _BALANCE.format(most=24))
q("category_totals", lambda sp, sf: show(select.category_totals(_kinds(sp, sf)), 2), f"WITH {_KINDS_SQL} SELECT category, {R('sum(importance)', 2)} AS importance, count(*) AS n_features FROM rk GROUP BY 1")


def _validated(sp, sf):
    out = []
    for name, df, target in (("named", bars(sp, sf), "close"), ("return", bars(sp, sf).withColumn("my_return", F.lit(0.5)), "nothing"), ("none", bars(sp, sf), "nothing"), ("text", bars(sp, sf), "symbol"),
                             ("narrow", bars(sp, sf).select("symbol", "ts", "pos", "close"), "close"), ("empty", bars(sp, sf).where("pos < 0"), "close")):
        try:
            out.append((name, select.validate(df, target)))
        except ValueError:
            out.append((name, "refused"))
    return sp.createDataFrame(out, "case string, target string")


q("validated_targets", _validated, values([("named", "close"), ("return", "my_return"), ("none", "refused"), ("text", "refused"), ("narrow", "refused"), ("empty", "refused")], '"case", target'))


def _directions(sp, sf):
    x = bars(sp, sf).withColumns({"probability_up": (F.col("pos") % 10) / 10.0, "prediction": F.col("close") - F.col("open")})
    a = models.predicted_direction(x, threshold=0.6).select("symbol", "pos", F.col("direction").cast("long").alias("by_probability"))
    return a.join(models.predicted_direction(x, "regression").select("symbol", "pos", F.col("direction").cast("long").alias("by_value")), ["symbol", "pos"])


q("predicted_directions", _directions, "SELECT symbol, pos, CASE WHEN (pos % 10) / 10.0 > 0.6 THEN 1 ELSE -1 END AS by_probability, CASE WHEN close - open > 0 THEN 1 ELSE -1 END AS by_value FROM bars", "bars")

# ---------------------------------------------------------------- random draws: what bounds them
q("random_slippage_bounds", lambda sp, sf: signalled(sp, sf).where("signal is not null").withColumn(
    "p", ledger.Slippage("random", low=0.01, high=0.1, seed=42).price(F.col("close"), F.col("signal"), F.lit(1.0))).select(
    "symbol", "ts", ((F.col("p") / F.col("close") - 1) * F.col("signal") * 100).between(0.0099999, 0.1000001).alias("within")).transform(show),
  "SELECT symbol, ts, TRUE AS within FROM sig WHERE signal IS NOT NULL", "sig")
