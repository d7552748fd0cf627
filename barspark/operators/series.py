"""Ordered operators for long series, without one task per key.

A plain ``Window.partitionBy("symbol")`` puts one whole symbol into one task.
Everything ordered in this package goes through the helpers below instead:

* rows carry ``pos``, the row number inside their key;
* rows are windowed by ``(key, pos div block)``, so a group never holds more than
  ``block`` rows (plus a halo), whatever the size of the key;
* ``frames``  - bounded look-back/look-ahead: each block also gets its neighbours' edge rows;
* ``scan``    - unbounded look-back (last value, running sum/max...): scan inside the
  block, one summary row per block, scan the summaries, add the carry;
* ``ewm``     - exponential averages: scan inside the block, the decayed tail of the
  preceding blocks is summed into the carry by a group-by, no scan at all.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SCAN_BLOCK = 65_536
FRAME_BLOCK = 3_072  # with its halo below the 4096 rows a window keeps in memory by default
EWM_BLOCK = 2_048
LEAST_WEIGHT = 1e-18


@dataclass(frozen=True)
class Series:
    """How rows are keyed and ordered: ``order by ts, *tie`` inside ``keys``."""

    keys: tuple[str, ...] = ("symbol",)
    ts: str = "ts"
    tie: tuple[str, ...] = ()
    pos: str = "pos"

    def order(self) -> list[Column]:
        return [F.col(c) for c in (self.ts, *self.tie)]

    def block(self, size: int) -> Column:
        return F.expr(f"`{self.pos}` div {int(size)}")

    def by(self, *keys: str) -> Series:
        return replace(self, keys=tuple(keys))


BARS = Series()


def utc_micros(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


# ---------------------------------------------------------------- lineage


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="barspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several branches of a plan, which would otherwise compute it
    once per branch; parquet (unlike a checkpoint) keeps column pruning and table sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


_staged: list[str] = []


def staged() -> int:
    """How many staged tables of this process are still there."""
    return len(_staged)


def drop_staged(spark: SparkSession, first: int = 0, keep: int = 0) -> int:
    """Delete the tables staged by this process, after the results that read them are written; how many there were.

    ``first`` is what ``staged`` gave before the work whose tables are meant, and the newest ``keep`` of them stay.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = _staged[first:len(_staged) - keep]
    del _staged[first:len(_staged) - keep]
    for one in gone:
        path = jvm.org.apache.hadoop.fs.Path(one)
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


# ---------------------------------------------------------------- row numbers


def number_rows(df: DataFrame, s: Series = BARS, bucket: str = "1 day", method: str = "time") -> DataFrame:
    """Add ``pos`` (0-based row number per key) without sorting a key in one task. Every row stays: null keys are a key, null times come first.

    ``time``:  rows are numbered inside fixed time buckets and shifted by the count of the
               earlier buckets. Right for series whose rows per bucket are bounded (bars).
    ``range``: rows are range-partitioned on (keys, ts, tie), so even a key whose rows all
               fall into one bucket is spread; the partitioning is written out because both
               the counts and the rows must see the same boundaries.
    """
    keys = list(s.keys)
    if method == "range":
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        df = df.repartitionByRange(parts, *keys, *s.order()).withColumn("_part", F.spark_partition_id())
        df = stage(df)
    else:
        df = df.withColumn("_part", F.floor(utc_micros(s.ts) / F.lit(int(pd.Timedelta(bucket) / pd.Timedelta(microseconds=1)))))
    df = together(df, [*keys, "_part"])
    counts = df.groupBy("_key").agg(_shared(F.count(F.lit(1)), df).alias("_n")).select("_key", "_n", *[F.col(f"_key.{c}") for c in (*keys, "_part")])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_key", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_key").orderBy(*s.order())
    return (
        df.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_key")
        .withColumn(s.pos, (F.col("_before") + F.col("_rn") - 1).cast("long"))
        .drop("_key", "_rn", "_before")
    )


def together(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of equal ``by`` in one partition, with the struct ``_key`` of it, in which null equals null; its last column is only in there.

    A group-by, a window and a join on ``_key`` then need no shuffle of their own.
    """
    return df.withColumn("_key", F.struct(*by)).drop(by[-1]).repartition("_key")


def _shared(agg: Column, df: DataFrame) -> Column:
    """``agg`` that reads every column: column pruning then leaves both branches of a self-join the same shuffle, which runs once."""
    return F.when(F.max(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).isNotNull(), agg)


def join_by(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns of one name, null equal to null; the right side's copies of them are dropped."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]), how).drop(*[f"_right_{c}" for c in on])


def numbered(df: DataFrame, s: Series = BARS) -> DataFrame:
    return df if s.pos in df.columns else number_rows(df, s)


# ---------------------------------------------------------------- scans


@dataclass(frozen=True)
class Scan:
    kind: str  # last | next | sum | count | max | min
    col: Column
    inclusive: bool = True


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last(c, inclusive: bool = True) -> Scan:
    """Latest non-null value up to (or, exclusive, before) the row."""
    return Scan("last", _as_col(c), inclusive)


def next_(c, inclusive: bool = True) -> Scan:
    """Earliest non-null value from (or, exclusive, after) the row."""
    return Scan("next", _as_col(c), inclusive)


def running_sum(c, inclusive: bool = True) -> Scan:
    return Scan("sum", _as_col(c), inclusive)


def running_max(c, inclusive: bool = True) -> Scan:
    return Scan("max", _as_col(c), inclusive)


def running_min(c, inclusive: bool = True) -> Scan:
    return Scan("min", _as_col(c), inclusive)


def scan(df: DataFrame, s: Series, outs: Mapping[str, Scan], block: int = SCAN_BLOCK) -> DataFrame:
    """Add one running value per entry of ``outs``; one shuffle of the data in all.

    The summaries come from a partial aggregation (one row per key and block), so what is
    scanned per key is ``rows / block`` rows.
    """
    df = numbered(df, s)
    keys = list(s.keys)
    x = df.withColumns({"_blk": s.block(block), **{f"_in_{o}": sc.col for o, sc in outs.items()}})

    def summary(o: str, sc: Scan) -> Column:
        v = F.col(f"_in_{o}")
        if sc.kind == "last":
            return F.max(F.when(v.isNotNull(), F.struct(s.pos, v.alias("v"))))["v"]
        if sc.kind == "next":
            return F.min(F.when(v.isNotNull(), F.struct(s.pos, v.alias("v"))))["v"]
        return {"sum": F.sum, "max": F.max, "min": F.min}[sc.kind](v)

    def running(sc: Scan, v: Column, w: WindowSpec) -> Column:
        if sc.kind in ("last", "next"):
            return F.last(v, ignorenulls=True).over(w)
        return {"sum": F.sum, "max": F.max, "min": F.min}[sc.kind](v).over(w)

    x = together(x, [*keys, "_blk"])
    names = [f"_c_{o}" for o in outs]
    per_block = x.groupBy("_key").agg(_shared(F.count(F.lit(1)), x).alias("_rows"), *[summary(o, sc).alias(n) for n, (o, sc) in zip(names, outs.items())])
    per_block = per_block.where("_rows > 0").select("_key", *names, *[F.col(f"_key.{c}") for c in (*keys, "_blk")])
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select("_key", *[running(sc, F.col(n), after if sc.kind == "next" else before).alias(n) for n, sc in zip(names, outs.values())])

    forward = Window.partitionBy("_key").orderBy(s.pos)
    # a frame that ends at "unbounded following" re-reads the rest for every row; order downwards instead
    backward = Window.partitionBy("_key").orderBy(F.desc(s.pos))
    local = {}
    for o, sc in outs.items():
        w = backward if sc.kind == "next" else forward
        w = w.rowsBetween(Window.unboundedPreceding, 0 if sc.inclusive else -1)
        local[f"_l_{o}"] = running(sc, F.col(f"_in_{o}"), w)
    x = x.withColumns(local).join(carry, "_key", "left")

    def combine(o: str, sc: Scan) -> Column:
        loc, car = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        if sc.kind == "sum":
            return F.when(loc.isNotNull() | car.isNotNull(), F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0)))
        if sc.kind == "max":
            return F.greatest(loc, car)
        if sc.kind == "min":
            return F.least(loc, car)
        return F.coalesce(loc, car)

    result = {o: combine(o, sc) for o, sc in outs.items()}
    kept = [c for c in df.columns if c not in result]
    return x.select(*kept, *[c.alias(o) for o, c in result.items()])


# ---------------------------------------------------------------- bounded frames


def frames(
    df: DataFrame,
    s: Series,
    make: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    block: int | None = None,
    keep_block: bool = False,
) -> DataFrame:
    """Run ``make(rows, window)`` where ``window`` sees ``back`` earlier and ``ahead`` later rows.

    Edge rows are copied to the neighbouring block and dropped again afterwards. With
    ``keep_block`` the result keeps ``_blk`` and ``_key``, so that a join on the latter needs no further shuffle.
    """
    block = block or max(FRAME_BLOCK, back, ahead)
    if max(back, ahead) > block:
        raise ValueError(f"look-back {back}/{ahead} is longer than the given block of {block} rows")
    df = numbered(df, s)
    own, inside = s.block(block), F.pmod(F.col(s.pos), F.lit(block))
    targets = [own]
    if back:
        targets.append(F.when(inside >= block - back, own + 1))
    if ahead:
        targets.append(F.when((inside < ahead) & (own > 0), own - 1))
    x = df.withColumn("_own", own)
    x = x.withColumn("_blk", F.explode(F.array_compact(F.array(*targets))) if len(targets) > 1 else own)
    x = make(x.withColumn("_key", F.struct(*s.keys, "_blk")), Window.partitionBy("_key").orderBy(s.pos))
    x = x.where(F.col("_own") == F.col("_blk")).drop("_own")
    return x if keep_block else x.drop("_blk", "_key")


def rolling(fn: Callable[[Column], Column], c: str | Column, w: WindowSpec, n: int) -> Column:
    """``fn`` over the last ``n`` rows; null until ``n`` non-null values are in the frame. Each row reads ``n`` rows."""
    c = _as_col(c)
    f = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(f) == n, fn(c).over(f))


def rolling_extremes(df: DataFrame, s: Series, outs: Mapping[str, tuple[str, str, int]]) -> DataFrame:
    """Add ``out: (max | min, column, n)`` over the last ``n`` rows, null until ``n`` non-null values are in the window.

    Rows are taken in stretches of ``n``. A window reaches over two of them at most, so its extreme is that of the first one's rest and the
    second one's beginning: two running values per row, whatever ``n`` is. Use it for long windows; ``rolling`` reads every row of a window.
    """
    df = numbered(df, s)
    longest = max(n for _, _, n in outs.values())

    def make(x: DataFrame, w: WindowSpec) -> DataFrame:
        helper: dict[str, Column] = {}
        for out, (kind, c, n) in outs.items():
            fn, stretch = {"max": F.max, "min": F.min}[kind], F.expr(f"`{s.pos}` div {int(n)}")
            here = Window.partitionBy("_key", stretch)
            helper |= {f"_{out}_begun": fn(c).over(here.orderBy(s.pos).rowsBetween(Window.unboundedPreceding, 0)),
                       f"_{out}_rest": fn(c).over(here.orderBy(F.desc(s.pos)).rowsBetween(Window.unboundedPreceding, 0)),
                       f"_{out}_known": F.count(c).over(w.rowsBetween(Window.unboundedPreceding, 0))}
        x = x.withColumns(helper)
        made = {}
        for out, (kind, _, n) in outs.items():
            both = {"max": F.greatest, "min": F.least}[kind]
            known = F.col(f"_{out}_known") - F.coalesce(F.lag(f"_{out}_known", n).over(w), F.lit(0))
            made[out] = F.when(known == n, both(F.lag(f"_{out}_rest", n - 1).over(w), F.col(f"_{out}_begun")))
        return x.withColumns(made).drop(*helper)

    return frames(df, s, make, back=longest)


def mean_parts(name: str, c: str | Column, w: WindowSpec, n: int) -> tuple[dict[str, Column], Column]:
    """A mean over the last ``n`` rows in two steps: columns to add first, and the mean made from them.

    The window is cut into stretches of about sqrt(n) rows. The sum of a stretch is taken once per row and the window's sum is
    that of the stretches that end in it, so a row costs about 2 sqrt(n) additions. Nothing is subtracted: a huge
    value or a NaN is gone when it leaves the window. Null until ``n`` non-null values are in the window.
    """
    c = _as_col(c)
    size = math.isqrt(max(0, n - 1)) + 1
    many, rest = divmod(n, size)
    parts = {}
    for tag, k in (("a", size), ("b", rest)):
        if k:
            f = w.rowsBetween(-(k - 1), 0)
            parts |= {f"_{name}_s{tag}": F.sum(c).over(f), f"_{name}_n{tag}": F.count(c).over(f)}

    def total(kind: str) -> Column:
        terms = [F.lag(f"_{name}_{kind}a", i * size).over(w) if i else F.col(f"_{name}_{kind}a") for i in range(many)]
        terms += [F.lag(f"_{name}_{kind}b", many * size).over(w)] if rest else []
        return reduce(lambda x, y: x + y, terms)

    return parts, F.when(total("n") == n, total("s") / n)


def rolling_means(x: DataFrame, w: WindowSpec, means: Mapping[str, tuple[str | Column, int]]) -> DataFrame:
    """Add ``out: (column, n)`` means over the last ``n`` rows (see ``mean_parts``)."""
    made = {out: mean_parts(out, c, w, n) for out, (c, n) in means.items()}
    helper = {k: v for parts, _ in made.values() for k, v in parts.items()}
    return x.withColumns(helper).withColumns({out: m for out, (_, m) in made.items()}).drop(*helper)


# ---------------------------------------------------------------- state through blocks


def by_groups(df: DataFrame, by: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``fn`` of the rows of many whole groups in order and their edges: group g has the rows from ``edges[g]`` to ``edges[g + 1]``. Null is a key like any other.

    A call gets the groups of a batch, or one longer group, so small groups cost little if ``fn`` takes them at once.
    """
    def cuts(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for c in by:
            now, before = (t.column(c).slice(k, t.num_rows - 1) for k in (1, 0))
            new |= pc.fill_null(pc.not_equal(now, before), False).to_numpy() | (now.is_null().to_numpy() != before.is_null().to_numpy())
        return (np.flatnonzero(new) + 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
                edges = [0, *cuts(t)]
                if len(edges) > 1:
                    yield from fn(t.slice(0, edges[-1]), np.array(edges)).combine_chunks().to_batches()
                rest = t.slice(edges[-1])
        if rest is not None:
            yield from fn(rest, np.array([0, rest.num_rows])).combine_chunks().to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def by_group(df: DataFrame, by: list[str], order: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of every group's rows in order, one call per group (see ``by_groups``); one group is held at a time."""
    return by_groups(df, by, order, lambda t, edges: pa.concat_tables([fn(t.slice(a, b - a)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]), schema)


def block_starts(tables: DataFrame, s: Series, fields: Mapping[str, str], compose: Callable[[list, list], list], apply: Callable[[list, Any], Any],
                 first: Any, state: str, fan: int = 256) -> DataFrame:
    """(keys, _blk, _start): the state in which every block of a key begins.

    ``tables`` has one row per key and block: a function of the state, kept in the columns ``fields`` (name: type). ``compose(f, g)`` is "first f, then
    g" and ``apply(f, state)`` its value; ``first`` is the state at the start of a key. ``fan`` functions in a row become one, so that a key is
    gone through in two short steps: over its chains, then inside each chain.
    """
    keys, names = list(s.keys), list(fields)
    schema = ", ".join(f"`{k}` {tables.schema[k].dataType.simpleString()}" for k in keys)
    tables = tables.withColumn("_chain", F.expr(f"_blk div {int(fan)}"))
    kept = ", ".join(f"{n} {t}" for n, t in fields.items())

    def rows(t: pa.Table) -> list[list]:
        return [list(f) for f in zip(*[t.column(n).to_pylist() for n in names])]

    def chain(t: pa.Table, edges: np.ndarray) -> pa.Table:
        f = rows(t)
        whole = [reduce(compose, f[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return pa.table({**{c: t.column(c).take(pa.array(edges[:-1])) for c in (*keys, "_chain")}, **{n: pa.array([w[i] for w in whole], t.schema.field(n).type) for i, n in enumerate(names)}})

    def starts(of: str):
        def run(t: pa.Table, edges: np.ndarray) -> pa.Table:
            f, out = rows(t), []
            begun = t.column("_start").to_pylist() if "_start" in t.column_names else None
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                out.append(begun[a] if begun else first)
                for one in f[a:b - 1]:
                    out.append(apply(one, out[-1]))
            return pa.table({**{c: t.column(c) for c in (*keys, of)}, "_start": out})
        return run

    chains = by_groups(tables, [*keys, "_chain"], ["_blk"], chain, f"{schema}, _chain bigint, {kept}")
    begun = by_groups(chains, keys, ["_chain"], starts("_chain"), f"{schema}, _chain bigint, _start {state}")
    return by_groups(join_by(tables, begun, [*keys, "_chain"], "inner"), [*keys, "_chain"], ["_blk"], starts("_blk"), f"{schema}, _blk bigint, _start {state}")


# ---------------------------------------------------------------- exponential averages


@dataclass(frozen=True)
class Ewm:
    """``span`` average of ``col`` (non-null). ``adjust`` as in the two usual definitions."""

    col: str
    span: float
    adjust: bool = False

    @property
    def decay(self) -> float:
        return 1.0 - 2.0 / (self.span + 1.0)

    def input(self, s: Series) -> Column:
        x = F.col(self.col).cast("double")
        if self.adjust:
            return x
        return F.when(F.col(s.pos) == 0, x).otherwise(x * (1.0 - self.decay))


def ewm_block(specs: Mapping[str, Ewm]) -> int:
    """Largest block for which ``decay ** (-block / 2)`` stays far from overflow."""
    small = min(e.decay for e in specs.values())
    if small <= 0.0:
        raise ValueError("span must be above 1")
    return int(min(EWM_BLOCK, 2 * math.floor(600.0 / -math.log(small))))


def ewm_carry(df: DataFrame, s: Series, specs: Mapping[str, Ewm], block: int, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """What the earlier blocks still weigh at the start of each block: one row per key and block.

    Rows whose weight in the average is below ``least_weight`` (1e-18 of a value, beyond what a double can show next to values of like
    size) are left out; with a smaller one more blocks are summed.
    """
    keys = list(s.keys)
    x = df.withColumns({"_blk": s.block(block), "_to_end": F.lit(block - 1) - F.pmod(F.col(s.pos), F.lit(block))})
    tails = x.groupBy(*keys, "_blk").agg(
        *[F.sum(e.input(s) * F.pow(F.lit(e.decay), F.col("_to_end"))).alias(f"_t_{o}") for o, e in specs.items()]
    )
    slowest = max(e.decay for e in specs.values())
    reach = max(1, math.ceil(math.log(least_weight) / (math.log(slowest) * block)))
    moved = tails.withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn(
        "_blk", F.col("_blk") + F.col("_step")
    )
    return moved.groupBy(*keys, "_blk").agg(
        *[
            F.sum(F.col(f"_t_{o}") * F.pow(F.lit(e.decay), F.lit(float(block)) * (F.col("_step") - 1))).alias(f"_e_{o}")
            for o, e in specs.items()
        ]
    )


def ewm_local(s: Series, specs: Mapping[str, Ewm], w: WindowSpec, block: int) -> dict[str, Column]:
    """Columns ``_y_*``: the average's part that comes from the row's own block (halo rows count 0)."""
    half = block / 2.0
    k = F.col(s.pos) - F.col("_blk") * block - half
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for o, e in specs.items():
        scaled = F.when(F.col("_own") == F.col("_blk"), e.input(s) * F.pow(F.lit(e.decay), -k))
        out[f"_y_{o}"] = F.sum(scaled).over(upto) * F.pow(F.lit(e.decay), k)
    return out


def ewm_result(s: Series, specs: Mapping[str, Ewm], block: int) -> dict[str, Column]:
    k = F.pmod(F.col(s.pos), F.lit(block))
    out = {}
    for o, e in specs.items():
        y = F.col(f"_y_{o}") + F.coalesce(F.col(f"_e_{o}"), F.lit(0.0)) * F.pow(F.lit(e.decay), k + 1)
        if e.adjust:
            y = y * (1.0 - e.decay) / (1.0 - F.pow(F.lit(e.decay), F.col(s.pos) + 1))
        out[o] = y
    return out


def ewm(df: DataFrame, s: Series, specs: Mapping[str, Ewm], back: int = 0,
        make: Callable[[DataFrame, WindowSpec], DataFrame] | None = None) -> DataFrame:
    """Add every average of ``specs``; ``make`` may add bounded-frame columns in the same pass."""
    df = numbered(df, s)
    block = ewm_block(specs)
    if back > block:  # a small span needs small blocks, a long look-back needs large ones: two passes
        df = frames(df, s, make, back=back) if make else df
        make, back = None, 0

    def both(x: DataFrame, w: WindowSpec) -> DataFrame:
        x = x.withColumns(ewm_local(s, specs, w, block))
        return make(x, w) if make else x

    x = frames(df, s, both, back=back, block=block, keep_block=True)
    carry = ewm_carry(df, s, specs, block)
    x = x.join(carry.select(F.struct(*s.keys, "_blk").alias("_key"), *[c for c in carry.columns if c.startswith("_e_")]), "_key", "left").drop("_key")
    helper = [c for o in specs for c in (f"_y_{o}", f"_e_{o}")]
    return x.withColumns(ewm_result(s, specs, block)).drop("_blk", *helper)
