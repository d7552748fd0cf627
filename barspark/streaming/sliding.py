"""Sliding windows that take one value at a time, and the batch features of one series made from them.

A window costs a constant number of steps per value, whatever its length, and nothing is ever subtracted: sums and deviations keep two
stacks (what is oldest is folded from its far end, what is newest is added up), extremes keep a monotonic queue. So a
spike is gone when it leaves the window, as in the batch operators.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable
from itertools import accumulate

from barspark.operators import features as F

EMA_SPANS = tuple(sorted({*F.AVERAGE_WINDOWS, F.MACD_FAST, F.MACD_SLOW}))
NONE = float("nan")  # how an unknown value is kept in stored arrays


class Folded:
    """The last ``n`` values folded by ``join``; unknown (null) values are counted, and the result is unknown while one is inside."""

    zero: object = None

    def __init__(self, n: int, values: Iterable[float | None] = ()) -> None:
        self.n, self.missing = n, 0
        self.raw: deque = deque()
        self.front: list = []  # folds of the oldest values, each entry without one more of them
        self.back = self.zero
        for v in values:
            self.push(v)

    def one(self, v: float):
        raise NotImplementedError

    def join(self, a, b):
        raise NotImplementedError

    def push(self, v: float | None) -> None:
        if len(self.raw) == self.n:
            if not self.front:
                self.front = list(accumulate((self._one(x) for x in reversed(self.raw)), lambda newer, older: self.join(older, newer)))
                self.back = self.zero
            self.front.pop()
            self.missing -= self.raw.popleft() is None
        self.raw.append(v)
        self.missing += v is None
        self.back = self.join(self.back, self._one(v))

    def _one(self, v: float | None):
        return self.zero if v is None else self.one(v)

    def folded(self):
        """None until the window is full of known values."""
        if len(self.raw) < self.n or self.missing:
            return None
        return self.join(self.front[-1], self.back) if self.front else self.back


class Mean(Folded):
    zero = 0.0

    def one(self, v: float) -> float:
        return v

    def join(self, a: float, b: float) -> float:
        return a + b

    def value(self) -> float | None:
        s = self.folded()
        return None if s is None else s / self.n


class Deviation(Folded):
    """Sample standard deviation; a fold is (count, mean, sum of squared distances from it)."""

    zero = (0, 0.0, 0.0)

    def one(self, v: float) -> tuple[int, float, float]:
        return 1, v, 0.0

    def join(self, a, b):
        if not a[0] or not b[0]:
            return b if not a[0] else a
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n

    def value(self) -> float | None:
        f = self.folded()
        return None if f is None else math.sqrt(f[2] / (self.n - 1))


class Extreme:
    """Largest (``sign`` 1) or smallest (-1) of the last ``n`` values: a queue of values none of which is outdone by a later one."""

    def __init__(self, n: int, sign: int, values: Iterable[float] = ()) -> None:
        self.n, self.sign, self.at = n, sign, 0
        self.queue: deque = deque()
        for v in values:
            self.push(v)

    def push(self, v: float) -> None:
        while self.queue and self.queue[-1][1] * self.sign <= v * self.sign:
            self.queue.pop()
        self.queue.append((self.at, v))
        self.at += 1
        if self.queue[0][0] <= self.at - 1 - self.n:
            self.queue.popleft()

    def value(self) -> float | None:
        return self.queue[0][1] if self.at >= self.n else None


# ---------------------------------------------------------------- the features of one series


def _ratio(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None or b == 0 else a / b


def _less(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a - b


def _ln(v: float | None) -> float | None:
    return math.log(v) if v is not None and v > 0 else None


def names() -> list[tuple[str, str]]:
    """(column, type) of ``Series.add`` in order."""
    levels = [f"{k}_{n}" for n in F.LEVEL_WINDOWS for k in ("resistance", "support", "dist_to_resistance", "dist_to_support")]
    numbers = [*[f"sma_{n}" for n in F.AVERAGE_WINDOWS], *[f"ema_{n}" for n in EMA_SPANS], "macd", "macd_signal", "macd_hist", *[f"roc_{n}" for n in F.RATE_WINDOWS],
               "rsi_14", "bollinger_upper", "bollinger_lower", "bollinger_middle", "stoch_k", "stoch_d", *[f"volatility_{n}" for n in F.VOLATILITY_WINDOWS], "atr_14", "normalized_atr", "gk_volatility",
               *levels, "price_accel"]
    return [(n, "double") for n in numbers] + [(n, "boolean") for n in ("doji", "hammer", "bullish_engulfing", "bearish_engulfing")]


NAMES = names()
LOOK_BACK = max(F.AVERAGE_WINDOWS) + 1  # bars after which no earlier one is in a window


class SeriesFeatures:
    """All look-back features of one series of bars, one bar at a time."""

    def __init__(self, periods: int = F.PERIODS_PER_YEAR) -> None:
        self.year = math.sqrt(periods)
        self._make([[] for _ in range(8)])
        self.seen, self.open, self.ema, self.signal = 0, None, None, 0.0

    def _make(self, w: list[list[float | None]]) -> None:
        closes, highs, lows, gains, losses, ranges, returns, stochastic = w
        self.closes = deque(closes, max(F.RATE_WINDOWS) + 1)
        self.returns_kept = deque(returns, 1)
        self.sma = {n: Mean(n, closes[-n:]) for n in F.AVERAGE_WINDOWS}
        self.spread = Deviation(20, closes[-20:])
        self.up, self.down, self.atr = Mean(F.RSI_WINDOW, gains), Mean(F.RSI_WINDOW, losses), Mean(F.ATR_WINDOW, ranges)
        self.volatility = {n: Deviation(n, returns[-n:]) for n in F.VOLATILITY_WINDOWS}
        self.top = {n: Extreme(n, 1, highs[-n:]) for n in {F.STOCHASTIC_WINDOW, *F.LEVEL_WINDOWS}}
        self.bottom = {n: Extreme(n, -1, lows[-n:]) for n in {F.STOCHASTIC_WINDOW, *F.LEVEL_WINDOWS}}
        self.stoch_d = Mean(3, stochastic)
        self.highs, self.lows = deque(highs, max(F.LEVEL_WINDOWS)), deque(lows, max(F.LEVEL_WINDOWS))

    # what is stored: the values inside the windows, the running averages
    def windows(self) -> list[list[float]]:
        kept = (self.sma[max(F.AVERAGE_WINDOWS)].raw, self.highs, self.lows, self.up.raw, self.down.raw, self.atr.raw, self.volatility[max(F.VOLATILITY_WINDOWS)].raw, self.stoch_d.raw)
        return [[NONE if v is None else float(v) for v in k] for k in kept]

    def averages(self) -> list[float]:
        return [] if self.ema is None else [*self.ema, self.signal, self.open]

    @classmethod
    def restored(cls, seen: int, windows: list[list[float]], averages: list[float], periods: int = F.PERIODS_PER_YEAR) -> SeriesFeatures:
        x = cls(periods)
        x._make([[None if v != v else v for v in w] for w in windows])
        x.seen = seen
        x.resume(averages)
        return x

    def resume(self, averages: list[float]) -> None:
        if len(averages):
            *ema, self.signal, self.open = (float(v) for v in averages)
            self.ema = ema

    def add(self, o: float, h: float, lo: float, c: float) -> tuple:
        """The values of ``NAMES`` at this bar."""
        pc, po = (self.closes[-1] if self.closes else None), self.open
        delta = 0.0 if pc is None else c - pc
        before = self.returns_kept[-1] if self.returns_kept else None
        r = _less(_ratio(c, pc), 1.0)
        self.closes.append(c)
        self.returns_kept.append(r)
        self.highs.append(h)
        self.lows.append(lo)
        for w in self.sma.values():
            w.push(c)
        self.spread.push(c)
        self.up.push(max(delta, 0.0))
        self.down.push(max(-delta, 0.0))
        self.atr.push(h - lo if pc is None else max(h - lo, abs(h - pc), abs(lo - pc)))
        for w in self.volatility.values():
            w.push(r)
        for w in self.top.values():
            w.push(h)
        for w in self.bottom.values():
            w.push(lo)
        top, bottom = self.top[F.STOCHASTIC_WINDOW].value(), self.bottom[F.STOCHASTIC_WINDOW].value()
        k = _ratio(_less(c, bottom), _less(top, bottom))
        k = None if k is None else 100 * k
        self.stoch_d.push(k)
        self.ema = [c] * len(EMA_SPANS) if self.ema is None else [e + (c - e) * 2 / (n + 1) for e, n in zip(self.ema, EMA_SPANS)]
        macd = self.ema[EMA_SPANS.index(F.MACD_FAST)] - self.ema[EMA_SPANS.index(F.MACD_SLOW)]
        self.signal = macd if not self.seen else self.signal + (macd - self.signal) * 2 / (F.MACD_SIGNAL + 1)
        self.seen += 1
        self.open = o

        sma = {n: w.value() for n, w in self.sma.items()}
        rates = [self.closes[-1 - n] if len(self.closes) > n else None for n in F.RATE_WINDOWS]
        up, down, spread, atr = self.up.value(), self.down.value(), self.spread.value(), self.atr.value()
        rsi = None if up is None else 100 - 100 / (1 + up / down) if down else 100.0 if up > 0 else None
        band = [None] * 2 if spread is None else [sma[20] + 2 * spread, sma[20] - 2 * spread]
        vol = [w.value() for w in self.volatility.values()]
        hl, co = _ln(_ratio(h, lo)), _ln(_ratio(c, o))
        gk = None if hl is None or co is None else 0.5 * hl * hl - (2 * math.log(2) - 1) * co * co
        levels = []
        for n in F.LEVEL_WINDOWS:
            t, b = self.top[n].value(), self.bottom[n].value()
            levels += [t, b, _ratio(_less(t, c), c), _ratio(_less(c, b), c)]
        body = abs(c - o)
        bigger = po is not None and body > abs(po - pc)
        thin = _ratio(body, c)
        flags = (thin is not None and thin < F.DOJI_LIMIT, max(o, c) - lo >= 2 * body and body > 0,
                 bigger and o < c and po > pc and o <= pc and c >= po, bigger and o > c and po < pc and o >= pc and c <= po)
        return (*sma.values(), *self.ema, macd, self.signal, macd - self.signal, *[None if v is None else 100 * (v - 1) for v in (_ratio(c, x) for x in rates)], rsi, *band, sma[20], k, self.stoch_d.value(),
                *[None if v is None else v * self.year for v in vol], atr, _ratio(atr, c), gk, *levels, _less(r, before), *flags)
