"""Rolling columns with a least number of values, and exponential averages as sums over blocks of rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quantlake.sources.bars import by_symbol


def rows(n: int) -> WindowSpec:
    return by_symbol().rowsBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return by_symbol().rowsBetween(Window.unboundedPreceding, 0)


def rolling(f: Callable[[Column], Column], x: Column, n: int, least: int) -> Column:
    """f over the last n rows; null until ``least`` of them have a value."""
    return F.when(F.count(x).over(rows(n)) >= least, f(x).over(rows(n)))


def sma(x: Column, n: int) -> Column:
    return rolling(F.avg, x, n, n // 2)


def zscore(x: Column, n: int) -> Column:
    least = max(2, n // 4)
    deviation = rolling(F.stddev_samp, x, n, least)
    return (x - rolling(F.avg, x, n, least)) / F.nullif(F.round(deviation, 12), F.lit(0.0))


def block_of(alpha: float) -> int:
    """Rows after which a value's weight has fallen to 1e-30: two such blocks hold all that a double can show."""
    return max(2, math.ceil(-30 / math.log10(1 - alpha)))


def ewm(x: Column, alpha: float, least: int, t: Column | None = None) -> Column:
    """Exponential average seeded with the first value, for histories of any length.

    Weights grow as (1 - alpha)^-t, so they are counted from the start of the block that a row is in; what came before is the
    sum of the block before it. Two running sums in one order of the symbol's rows; ``t`` is the place in it, from 0.
    """
    t = F.row_number().over(by_symbol()) - 1 if t is None else t
    size, decay = block_of(alpha), F.lit(1 - alpha)
    inside, block = t % size, F.floor(t / size)
    part = F.when(t == 0, 1.0).otherwise(alpha) * F.pow(decay, -inside) * x
    own = Window.partitionBy("symbol", block).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("symbol").orderBy(block).rangeBetween(-1, -1)
    total = F.sum(part).over(own) + F.pow(decay, F.lit(size)) * F.coalesce(F.sum(part).over(before), F.lit(0.0))
    return F.when(F.count(x).over(so_far()) >= least, F.pow(decay, inside) * total)


def ema(x: Column, span: int) -> Column:
    return ewm(x, 2 / (span + 1), span // 2)


def rma(x: Column, n: int) -> Column:
    return ewm(x, 1 / n, n)


def rank_pct(x: Column, by: str, least: int, key: str) -> Column:
    """Average rank within ``by`` as a share of the non-null values; null where fewer than ``least`` rows are."""
    whole = Window.partitionBy(by)
    rank = F.rank().over(whole.orderBy(x.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, x))
    return F.when((F.count(key).over(whole) >= least) & x.isNotNull(), (rank + (ties - 1) / 2.0) / F.count(x).over(whole))
