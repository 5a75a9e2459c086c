"""Numbers (M1-M13, W6, W7, P16-P18): null-safe scaling, indexes, bins and rounding.

Missing is NULL throughout: NaN and infinities become NULL at the door (``finite``). Rounding is half up as in SQL, or
half to even with ``parity``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_number(c: Column) -> Column:
    """M1: number or null."""
    return finite(c.try_cast("double"))


def safe_divide(a: Column, b: Column, fallback: float | None = None) -> Column:
    """M3."""
    out = finite(F.try_divide(a.cast("double"), b.cast("double")))
    return out if fallback is None else F.coalesce(out, F.lit(fallback))


def clip(c: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """M6: null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def rounded(c: Column, digits: int, parity: bool = False) -> Column:
    """M8."""
    return F.bround(c, digits) if parity else F.round(c, digits)


def round_even(c: Column, digits: int) -> Column:
    """Half to even as the SQL's round_even: what is a tie is decided on the scaled double, not on its decimal text."""
    return F.rint(c.cast("double") * float(10**digits)) / float(10**digits)


def capped_growth(raw: Column, cap: float | Column) -> tuple[Column, Column]:
    """M5: (value, whether the cap was hit); not finite counts as hit."""
    known, most = finite(raw), cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.coalesce(F.least(known, most), most), known.isNull() | (known > most)


def within(c: Column, low: float, high: float) -> Column:
    """both ends included, null is outside."""
    return F.coalesce(c.between(low, high), F.lit(False))


def ensured(df: DataFrame, columns: list[str], default: float = 0.0) -> DataFrame:
    """Columns that a table lacks, with a default."""
    return df.select("*", *(F.lit(default).alias(c) for c in columns if c not in df.columns))


def named_by_place(df: DataFrame, *names: str) -> DataFrame:
    """The first columns renamed by their place."""
    return df.toDF(*names, *df.columns[len(names) :])


def column_list(df: DataFrame, limit: int = 40) -> str:
    """Names of the first columns as text."""
    return ",".join(df.columns[:limit])


def cut(c: Column, edges: list[float], labels: list[str], parity: bool = False) -> Column:
    """Right-closed bins; outside of all bins null, or the text 'nan' with ``parity``."""
    case = None
    for low, high, label in zip(edges, edges[1:], labels):
        case = (F if case is None else case).when((c > low) & (c <= high), F.lit(label))
    return case.otherwise(F.lit("nan") if parity else F.lit(None).cast("string"))


def weighted_index(parts: dict[str, float], of: Callable[[str], Column] = F.col) -> Column:
    """Sum of weight times column, missing as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(of(k), F.lit(0.0)) * F.lit(float(w)) for k, w in parts.items()))


def price_blend(a: Column, b: Column, share: float = 0.35) -> Column:
    """Weighted mean of two prices; one stands in for the other, zeros count as missing."""
    x, y = F.nullif(a, F.lit(0.0)), F.nullif(b, F.lit(0.0))
    return F.coalesce(x, y) * share + F.coalesce(y, x) * (1 - share)


def gate(base: Column, *brakes: tuple[Column, float]) -> Column:
    """Base times (1 - weight * brake) for each brake."""
    return reduce(lambda a, b: a * (1 - F.lit(b[1]) * F.coalesce(b[0], F.lit(0.0))), brakes, base)


def row_mean(*columns: Column) -> Column:
    """Mean over columns, nulls left out."""
    total = reduce(lambda a, b: a + b, (F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns))
    return F.try_divide(total, reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns)))


def dot(a: Column, b: Column) -> Column:
    """M13, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """M10; null for a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def minmax(df: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """0-100 scaling over the whole table, any number of columns in one pass.

    ``specs``: new column to (column, mode), mode of '', 'log', 'invert', 'log invert'. A constant or missing column
    gives 50 for all rows, a missing cell 0 (after inversion). The extremes are one row, joined to all: no window
    over the whole table.
    """
    logged = {
        k: F.log1p(F.when(finite(F.col(c)).isNotNull(), F.greatest(finite(F.col(c)), F.lit(0.0)))) if "log" in mode else finite(F.col(c))
        for k, (c, mode) in specs.items()
    }
    bounds = df.agg(*(f(v).alias(f"__{name}_{k}") for k, v in logged.items() for name, f in (("lo", F.min), ("hi", F.max))))
    out = df.crossJoin(F.broadcast(bounds))  # one row
    for k, (_, mode) in specs.items():
        v, lo, hi = logged[k], F.col(f"__lo_{k}"), F.col(f"__hi_{k}")
        flat = lo.isNull() | (F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(lo), F.abs(hi)))
        scaled = F.try_divide(v - lo, hi - lo) * 100
        scaled = 100 - scaled if "invert" in mode else scaled
        out = out.withColumn(
            k, F.when(flat, F.lit(50.0)).otherwise(F.least(F.greatest(F.coalesce(scaled, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)))
        )
    return out.drop(*bounds.columns)


def zscore(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Population standard deviation, zero counts as 1."""
    stats = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        spread = F.coalesce(F.nullif(F.col(f"__s_{c}"), F.lit(0.0)), F.lit(1.0))
        out = out.withColumn(c + suffix, (F.col(c) - F.col(f"__m_{c}")) / spread)
    return out.drop(*stats.columns)
