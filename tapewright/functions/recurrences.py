"""Recursive indicators: one grouped pass per symbol computes all that are asked for.

A symbol's history is bounded by its bars (a century of five-minute bars is a few
hundred MB at most for one column), so a group fits a task.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame


def ema(x: np.ndarray, n: int, seed: str = "sma") -> np.ndarray:
    """Exponential mean with ``alpha = 2 / (n + 1)``, seeded by the mean of the first ``n`` values or by the first."""
    out, alpha = np.full(len(x), np.nan), 2 / (n + 1)
    first = n - 1 if seed == "sma" else 0
    if len(x) <= first:
        return out
    out[first] = value = x[:n].mean() if seed == "sma" else x[0]
    for i in range(first + 1, len(x)):
        out[i] = value = alpha * x[i] + (1 - alpha) * value
    return out


def dema(x: np.ndarray, n: int) -> np.ndarray:
    """Twice the mean less the mean of the mean, the second over the known values of the first."""
    one = ema(x, n)
    out = np.full(len(x), np.nan)
    known = one[n - 1 :]
    if len(x) >= n:
        out[n - 1 :] = 2 * known - ema(known, n)
    return out


def rsi_wilder(x: np.ndarray, n: int = 14) -> np.ndarray:
    """RSI with Wilder's smoothing; the first value is one bar after the first full window."""
    out, d = np.full(len(x), np.nan), np.diff(x)
    if len(d) <= n:
        return out
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, z = gain[:n].mean(), loss[:n].mean()
    for i in range(n, len(d)):
        g, z = (g * (n - 1) + gain[i]) / n, (z * (n - 1) + loss[i]) / n
        out[i + 1] = 100.0 if z == 0 else 100 - 100 / (1 + g / z)
    return out


def macd_histogram(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> np.ndarray:
    """Difference of two means less its own mean; null under ``slow + signal`` bars."""
    line = (ema(x, fast) - ema(x, slow))[slow - 1 :]
    out = np.full(len(x), np.nan)
    if len(x) >= slow:
        out[slow - 1 :] = line - ema(line, signal)
    out[: slow + signal - 1] = np.nan
    return out


def smoothed_stochastic(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 87) -> np.ndarray:
    """Place of the close in the range of ``n`` bars (50 when flat), smoothed by a third of each new value."""
    out, value = np.full(len(close), np.nan), None
    for i in range(n - 1, len(close)):
        top, bottom = high[i - n + 1 : i + 1].max(), low[i - n + 1 : i + 1].min()
        raw = 50.0 if top == bottom else (close[i] - bottom) / (top - bottom) * 100
        out[i] = value = raw if value is None else 2 / 3 * value + raw / 3
    return out


@dataclass(frozen=True)
class Indicator:
    """A named recursive column: ``kind`` is a function above, ``column`` its input."""

    name: str
    kind: str
    n: int = 0
    column: str = "close"
    seed: str = "sma"


def _value(frame, spec: Indicator) -> np.ndarray:
    x = frame[spec.column].to_numpy(float)
    if spec.kind == "ema":
        return ema(x, spec.n, spec.seed)
    if spec.kind == "dema":
        return dema(x, spec.n)
    if spec.kind == "rsi":
        return rsi_wilder(x, spec.n)
    if spec.kind == "macd":
        return macd_histogram(x)
    if spec.kind == "macd_signal":
        return ema(ema(x, 12, "first") - ema(x, 26, "first"), 9, "first")
    if spec.kind == "ewm":
        return ema(x, spec.n, "first")
    if spec.kind == "stochastic":
        return smoothed_stochastic(frame["high"].to_numpy(float), frame["low"].to_numpy(float), x, spec.n)
    raise ValueError(f"no indicator is named {spec.kind}")


def recursive(bars: DataFrame, specs: Iterable[Indicator]) -> DataFrame:
    """``symbol, ts`` and one column for each indicator, in one pass over each symbol's bars."""
    specs = list(specs)

    def one(frame):
        import pandas as pd

        frame = frame.sort_values("ts")
        found = {s.name: _value(frame, s) for s in specs}
        out = pd.DataFrame({"symbol": frame["symbol"].to_numpy(), "ts": frame["ts"].to_numpy(), **found})
        return out.astype(object).where(out.notna(), None)

    kind = bars.schema["ts"].dataType.simpleString()
    needed = ["symbol", "ts", *sorted({s.column for s in specs} | {"high", "low", "close"})]
    return bars.select(*needed).groupBy("symbol").applyInPandas(one, f"symbol string, ts {kind}, " + ", ".join(f"{s.name} double" for s in specs))


def with_indicators(bars: DataFrame, specs: Iterable[Indicator]) -> DataFrame:
    """All columns of the bars and one for each indicator: one pass over each symbol, nothing is joined back."""
    specs = list(specs)

    def one(frame):
        frame = frame.sort_values("ts", ignore_index=True)
        found = frame.assign(**{s.name: _value(frame, s) for s in specs})
        return found.astype(object).where(found.notna(), None)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields] + [f"{s.name} double" for s in specs]
    return bars.groupBy("symbol").applyInPandas(one, ", ".join(kinds))
