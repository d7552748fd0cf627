"""Rolling and expanding time folds as tags on rows.

Rolling folds are evenly spaced, so the folds of a row follow from its time or number by division: a row is unfolded into
its range of fold numbers, whatever the number of folds, without a join.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.operators.series import BARS, Series, numbered

# ---- fixed values: days per period letter
PERIOD_DAYS = {"D": 1, "W": 7, "M": 30, "Q": 90, "Y": 365}
# ---- end of fixed values

Period = str | int | dt.timedelta


@dataclass(frozen=True)
class Fold:
    """Half-open ranges of timestamps or of row numbers."""

    fold: int
    train_start: dt.datetime | int
    train_end: dt.datetime | int
    test_end: dt.datetime | int


def parse_period(p: Period | None) -> int | dt.timedelta | None:
    if p is None or isinstance(p, (int, dt.timedelta)):
        return p
    m = re.fullmatch(r"(\d+)([DWMQY]?)", p.strip())
    if not m:
        raise ValueError(f"unknown period {p!r}")
    return dt.timedelta(days=int(m[1]) * PERIOD_DAYS[m[2]]) if m[2] else int(m[1])


@dataclass(frozen=True)
class Rolling:
    """``count`` folds: number i trains from ``begin + i * step`` on for ``train``, then tests for ``test``.

    With ``most`` the training rows are those of the last ``most`` before the test, from ``begin`` at the earliest.
    """

    begin: dt.datetime | int
    train: dt.timedelta | int
    test: dt.timedelta | int
    step: dt.timedelta | int
    count: int
    most: dt.timedelta | int | None = None

    def fold(self, i: int) -> Fold:
        first = self.begin + i * self.step
        cut = first + self.train
        return Fold(i, first if self.most is None else max(self.begin, cut - self.most), cut, cut + self.test)

    def numbers(self, at: Column) -> tuple[Column, Column, Column]:
        """Of a row at ``at`` (row number, or microseconds): first fold tested, last fold tested, last fold trained.

        It tests folds from the first to the second, and trains those after the second up to the third.
        """
        def whole(v) -> int:
            return v if isinstance(v, int) else v // dt.timedelta(microseconds=1)

        begin = self.begin if isinstance(self.begin, int) else whole(_utc(self.begin) - dt.datetime(1970, 1, 1))
        train, test, step = whole(self.train), whole(self.test), whole(self.step)
        reach = whole(self.most) if self.most is not None else train
        past = at - (begin + train)

        def down(x: Column) -> Column:
            return (x - F.pmod(x, F.lit(step))) / step

        first, last, trained = down(past - test) + 1, down(past), down(past + reach)
        outside = at < begin  # rows before the first fold belong to none, however long its training may be
        return (F.greatest(F.lit(0), first).cast("long"), F.least(F.lit(self.count - 1), last).cast("long"),
                F.when(outside, F.lit(-1)).otherwise(F.least(F.lit(self.count - 1), trained)).cast("long"))


def _utc(t: dt.datetime) -> dt.datetime:
    return t.astimezone(dt.timezone.utc).replace(tzinfo=None)


def rolling(start, end, n_rows: int, train: Period, test: Period, step: Period | None = None,
            max_train: Period | None = None, n_splits: int | None = None) -> Rolling:
    """All folds that fit between start and end. Row counts when train and test are both counts, else times.

    Counts mixed with times are turned into times by the average row distance; ``n_splits`` sets the step so that so many
    folds fit. ``max_train`` bounds the window back from its end, and so may also lengthen it.
    """
    tr, te, mx = parse_period(train), parse_period(test), parse_period(max_train)
    st = parse_period(test if step is None else step)
    rows = isinstance(tr, int) and isinstance(te, int)
    if rows:
        low, size, zero, most = 0, n_rows, 0, mx if isinstance(mx, int) else None
    else:
        gap = (end - start) / max(1, n_rows - 1)
        tr, te, st, most = (v * gap if isinstance(v, int) else v for v in (tr, te, st, mx))
        low, size, zero = start, end - start, dt.timedelta(0)
    if n_splits is not None:
        unit = 1 if rows else dt.timedelta(days=1)
        spare = size // unit - tr // unit - te // unit
        if spare <= 0:
            raise ValueError("the data are too short for these periods")
        st = te // unit * unit if n_splits == 1 else spare // (n_splits - 1) * unit
        st = max(st, unit) if rows else st
    if type(st) is not type(zero) or st <= zero:
        raise ValueError("the step must be positive, and a number of rows where the periods are")
    left = size - tr - te
    return Rolling(low, tr, te, st, left // st + 1 if left >= zero else 0, most)


def fold_ranges(start, end, n_rows: int, train: Period, test: Period, step: Period | None = None,
                max_train: Period | None = None, n_splits: int | None = None) -> list[Fold]:
    """The folds of ``rolling`` one by one, for a look at them."""
    r = rolling(start, end, n_rows, train, test, step, max_train, n_splits)
    return [r.fold(i) for i in range(r.count)]


def expanding_ranges(n_rows: int, n_splits: int) -> list[Fold]:
    """Equal test blocks at the end, everything before a block is its training set."""
    size = n_rows // (n_splits + 1)
    first = n_rows - n_splits * size
    return [Fold(i, 0, first + i * size, first + (i + 1) * size) for i in range(n_splits)]


def tag_folds(df: DataFrame, folds: Rolling | Sequence[Fold], s: Series = BARS) -> DataFrame:
    """One copy of a row per fold it belongs to, with ``split_index`` and ``split_type``.

    A list of row ranges (a handful, as of ``expanding_ranges``) is tested range by range.
    """
    if isinstance(folds, Rolling):
        if not folds.count:
            return df.withColumns({"split_index": F.lit(0), "split_type": F.lit("")}).where(F.lit(False))
        at = F.col(s.pos) if isinstance(folds.begin, int) else F.unix_micros(F.col(s.ts).cast("timestamp"))
        first, tested, trained = folds.numbers(at)
        x = df.withColumns({"_first": first, "_tested": tested, "_last": F.greatest(tested, trained)}).where("_first <= _last")
        x = x.withColumn("split_index", F.explode(F.sequence(F.col("_first").cast("int"), F.col("_last").cast("int"))))
        kind = F.when(F.col("split_index") <= F.col("_tested"), "test").otherwise("train")
        return x.select(*[F.col(f"`{c}`") for c in df.columns], "split_index", kind.alias("split_type"))
    at = F.col(s.pos)

    def tag(f: Fold) -> Column:
        kind = F.when((at >= f.train_start) & (at < f.train_end), F.lit("train")).when((at >= f.train_end) & (at < f.test_end), F.lit("test"))
        return F.when(kind.isNotNull(), F.struct(F.lit(f.fold).alias("split_index"), kind.alias("split_type")))

    return df.select("*", F.inline(F.array_compact(F.array(*[tag(f) for f in folds]))))


def time_folds(df: DataFrame, train: Period, test: Period, step: Period | None = None, max_train: Period | None = None,
               n_splits: int | None = None, start=None, end=None, s: Series = BARS) -> DataFrame:
    """Tag rows with rolling folds; folds without training or without test rows are left out.

    Time folds are common to all symbols, row folds count rows inside each symbol (up to the longest).
    """
    df = numbered(df, s)
    edge = df.agg(F.min(F.col(s.ts).cast("timestamp")).alias("a"), F.max(F.col(s.ts).cast("timestamp")).alias("b"),
                  (F.max(s.pos) + 1).alias("n")).first()
    if edge["n"] is None:
        return tag_folds(df, Rolling(0, 1, 1, 1, 0), s)
    tagged = tag_folds(df, rolling(start or edge["a"], end or edge["b"], edge["n"], train, test, step, max_train, n_splits), s)
    sizes = tagged.groupBy("split_index").agg(F.count_distinct("split_type").alias("kinds")).where("kinds = 2")
    return tagged.join(sizes.select("split_index"), "split_index", "left_semi")


def expanding_folds(df: DataFrame, n_splits: int = 5, s: Series = BARS) -> DataFrame:
    df = numbered(df, s)
    n = df.agg((F.max(s.pos) + 1).alias("n")).first()["n"]
    return tag_folds(df, expanding_ranges(n, n_splits), s)


def fold_sizes(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("split_index").agg(
        F.count_if(F.col("split_type") == "train").alias("train_rows"),
        F.count_if(F.col("split_type") == "test").alias("test_rows"))
