"""Exact quantiles of groups of any size (G15, G24, G29, G39, M9), by distributed selection.

``percentile`` keeps every distinct value of a group in one task. Here a group's values are only counted in cells that
are ordered as the values are, with the least and the greatest value of each cell. The counts tell which cell holds a
rank that is sought; that cell alone is divided again, and so on, until its values are all equal or at most FEW, which
are then sorted. All groups and quantiles share the passes. The first cells are powers of 2**(1/16) of either sign, the
next ones equal parts of a cell; five passes divide doubles to the last bit, two or three are usual. A group's state is
at most CELLS counts a pass, summed before they are shuffled, and FEW values in the end.

Null and NaN values are left out, and infinite ones count as the ends; a group without values has none. Results are
those of ``percentile`` bit for bit: the two neighbours of the position (n - 1) * q, weighted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import settled

#: Parts of a cell in a later pass.
CELLS = 1 << 16
#: Values of a cell that are sorted at once.
FEW = 4096
#: The first pass: cells for a factor of two, and the exponent below all doubles.
STEPS, LOWEST = 16, 1080


def _coarse(x: Column) -> Column:
    """A cell number that never falls as x grows; 0 for zeros, beyond all others for infinite values."""
    size = F.when(F.abs(x) == float("inf"), F.lit((LOWEST + 1100) * STEPS)).otherwise(F.floor((F.log2(F.abs(x)) + LOWEST) * STEPS))
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0)).cast("long")


def _equal(keys: Sequence[str]) -> Column:
    """Keys are those of the other side, which has them under names with two underscores more; nulls are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return on


def _other(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"{k}__") for k in keys]


def _located(cells: DataFrame, keys: Sequence[str], ranks: DataFrame | None, qs: Sequence[float]) -> DataFrame:
    """keys, rank, start, n, lo, hi: the cell that holds each sought rank; ``start`` ranks lie before it.

    ``cells`` has keys, start (of the cell that was divided), cell, n, lo, hi. Without ``ranks`` these are made of the groups' sizes.
    """
    order = Window.partitionBy(*keys, "start").orderBy("cell")
    placed = cells.withColumn("end", F.col("start") + F.sum("n").over(order))
    if ranks is None:
        placed = placed.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
        sought = F.array_distinct(F.array(*[f(F.lit(q) * (F.col("total") - 1)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
        inside = F.filter("sought", lambda r: (r >= F.col("end") - F.col("n")) & (r < F.col("end")))
        return placed.withColumn("sought", sought).select(*keys, F.explode(inside).alias("rank"), (F.col("end") - F.col("n")).alias("start"), "n", "lo", "hi")
    named = ranks.select(*_other([*keys, "start"]), "rank")
    holds = (F.col("rank") >= F.col("end") - F.col("n")) & (F.col("rank") < F.col("end"))
    return placed.join(named, _equal([*keys, "start"]) & holds).select(*keys, "rank", (F.col("end") - F.col("n")).alias("start"), "n", "lo", "hi")


def _inside(rows: DataFrame, open_cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that lie in one of their group's open cells (which are disjoint), with that cell."""
    spans = open_cells.select(*_other(keys), "lo", "hi", "start").distinct()  # two a quantile and group
    on = _equal(keys) & (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    return rows.join(spans, on).select(*keys, "x", "lo", "hi", "start")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, /, few: int = FEW, **quantiles: float) -> DataFrame:
    """One row per group that has values: keys, and a column for each of ``quantiles`` (name to share).

    Without keys there is one row, and none without values.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    names = list(keys) or ["__all"]
    rows = df.select(*([F.col(k) for k in keys] or [F.lit(0).alias("__all")]), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    measures = [F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    cells = rows.groupBy(*names, F.lit(0).cast("long").alias("start"), _coarse(F.col("x")).alias("cell")).agg(*measures)
    qs = list(quantiles.values())
    located = settled(_located(cells, names, None, qs), "quantile-cells")
    done = []
    while True:
        done.append(located.where("lo = hi").select(*names, "rank", F.col("lo").alias("x")))
        small = located.where(f"lo < hi AND n <= {few}")
        values = _inside(rows, small, names).groupBy(*names, "start").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # FEW values
        wanted = small.select(*_other([*names, "start"]), "rank")
        done.append(values.join(wanted, _equal([*names, "start"])).select(*names, "rank", F.get("xs", (F.col("rank") - F.col("start")).cast("int")).alias("x")))
        wide = located.where(f"lo < hi AND n > {few}")
        if wide.isEmpty():
            break
        part = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS).cast("long")
        again = _inside(rows, wide, names).select(*names, "start", part.alias("cell"), "x").groupBy(*names, "start", "cell").agg(*measures)
        located = settled(_located(again, names, wide, qs), "quantile-cells")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return _blended(found, rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names, quantiles).select(*keys, *quantiles)


def _blended(found: DataFrame, sizes: DataFrame, keys: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    """The values at the neighbouring ranks of each position, weighted as ``percentile`` does."""
    ranked = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("at"))  # two a quantile
    sizes = sizes.select(*_other(keys), "n")
    out = []
    for name, q in quantiles.items():
        place = F.lit(q) * (F.col("n") - 1)
        low, high = F.floor(place).cast("long"), F.ceil(place).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        out.append(F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b).alias(name))
    return ranked.join(sizes, _equal(keys)).select(*keys, *out)
