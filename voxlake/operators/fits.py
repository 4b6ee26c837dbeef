"""Moments, mixture fits and ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_moments(rows: DataFrame, by: list[str], dims: list[str], weight: str) -> DataFrame:
    """(by, mass, m_<dim>, v_<dim>_<dim>): weighted means and population covariances, in two passes."""
    w = F.col(weight)
    means = rows.groupBy(*by).agg(F.sum(w).alias("mass"), *[(F.sum(w * F.col(d)) / F.sum(w)).alias(f"m_{d}") for d in dims])
    gap = lambda d: F.col(d) - F.col(f"m_{d}")
    spread = [(F.sum(w * gap(a) * gap(b)) / F.first("mass")).alias(f"v_{a}_{b}") for i, a in enumerate(dims) for b in dims[i:]]
    return means.join(rows.join(means, by).groupBy(*by).agg(*spread), by)


def _split(x: DataFrame, half: int) -> tuple[float, int]:
    """(s, below): the least value of x(s, c) up to which half rows or more lie, and the number of rows below it.

    Values are dealt out by range; the running count is taken in the one range that holds the place.
    """
    ranged = x.repartitionByRange("s").withColumn("_p", F.spark_partition_id()).persist()
    try:
        before = 0
        for p, c in sorted(tuple(r) for r in ranged.groupBy("_p").agg(F.sum("c")).collect()):
            if before + c >= half:
                break
            before += c
        up = Window.partitionBy("_p").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
        here = ranged.where(F.col("_p") == p).withColumn("_u", F.sum("c").over(up) + before).where(F.col("_u") >= half)
        at = here.orderBy("s").select("s", F.col("_u") - F.col("c")).first()
        return at[0], at[1]
    finally:
        ranged.unpersist()


def mixture(rows: DataFrame, value: str, steps: int = 64) -> DataFrame:
    """(mf, mb, pb, sd): two normal components of one width by expectation-maximisation, split at the median to begin.

    Values are first counted, so each step is one aggregation over distinct values; a step's four numbers are all that
    comes back to the driver.
    """
    x = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("s")).agg(F.count("*").alias("c")).persist()
    try:
        n = x.agg(F.sum("c")).first()[0] or 0
        if not n:
            return rows.sparkSession.createDataFrame([], "mf double, mb double, pb double, sd double")
        half = n // 2
        split, below = _split(x, half)
        low = F.when(F.col("s") < split, F.col("c")).when(F.col("s") == split, F.lit(half - below)).otherwise(0)
        first = x.withColumn("l", low).agg(
            F.sum(F.col("l") * F.col("s")).alias("lo"), F.sum((F.col("c") - F.col("l")) * F.col("s")).alias("hi"),
            F.sum(F.col("c") * F.col("s")).alias("one"), F.sum(F.col("c") * F.col("s") * F.col("s")).alias("two"),
        ).first()
        mf, mb, pb = first.hi / max(1, n - half), first.lo / max(1, half), 0.5
        sd = max(1e-9, max(0.0, first.two / n - (first.one / n) ** 2) ** 0.5)
        for _ in range(steps):
            odds = F.log(F.lit(pb / (1 - pb))) + (F.pow(F.col("s") - mf, 2) - F.pow(F.col("s") - mb, 2)) / (2 * sd * sd)
            b, f = F.col("c") * (1 / (1 + F.exp(-odds))), F.col("c") * (1 - 1 / (1 + F.exp(-odds)))
            s = x.agg(
                F.sum(b).alias("b"), F.sum(b * F.col("s")).alias("bs"), F.sum(b * F.col("s") * F.col("s")).alias("bss"),
                F.sum(f).alias("f"), F.sum(f * F.col("s")).alias("fs"), F.sum(f * F.col("s") * F.col("s")).alias("fss"),
            ).first()
            if s.b <= 0 or s.f <= 0:  # one component has no mass left: the fit stays
                break
            mb, mf, pb = s.bs / s.b, s.fs / s.f, min(1 - 1e-12, s.b / n)
            sd = max(1e-9, max(0.0, (s.bss - s.b * mb * mb + s.fss - s.f * mf * mf) / n) ** 0.5)
        if steps >= 64 and mf < mb:
            mf, mb, pb = mb, mf, 1 - pb
        return rows.sparkSession.createDataFrame([(mf, mb, pb, sd)], "mf double, mb double, pb double, sd double")
    finally:
        x.unpersist()


def differences(series: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """(by, order, d) of consecutive values of each series; series has one row a tick."""
    return series.select(*by, order, (F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order))).alias("d")).where("d is not null")


def lag_autocorrelation(series: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """(by, rho): lag-1 autocorrelation about the mean of each series, covariance over n - 1 and variance over n.

    Series of fewer than two values, and constant ones, have none.
    """
    own = Window.partitionBy(*by)
    e = series.select(*by, order, (F.col(value) - F.avg(value).over(own)).alias("e"))
    e = e.withColumn("p", F.lag("e").over(own.orderBy(order)))
    var = F.sum(F.col("e") * F.col("e")) / F.count("*")
    rho = F.when((var > 0) & (F.count("*") > 1), F.sum(F.col("e") * F.col("p")) / F.nullif(F.count("*") - 1, F.lit(0)) / var)
    return e.groupBy(*by).agg(rho.alias("rho")).where("rho is not null")


def ring_churn(series: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """(by, churn): mean absolute difference of neighbours on each series' ring, whose last tick is followed by its first."""
    ring = Window.partitionBy(*by).orderBy(order)
    after = F.coalesce(F.lead(value).over(ring), F.first(value).over(ring))
    return series.select(*by, F.abs(F.col(value) - after).alias("_d")).groupBy(*by).agg(F.avg("_d").alias("churn"))


def moving_average(series: DataFrame, order: str, value: str, alpha: float, by: list[str]) -> DataFrame:
    """(by, order, ema): e_0 = v_0, e_t = alpha v_t + (1 - alpha) e_{t-1}, folded in order over each series, which is as
    short as a capture; series has one row a tick."""
    row = F.struct(F.col(order).alias("k"), F.col(value).alias("v"))
    ticks = series.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("a"))
    fold = F.aggregate(
        "a", F.array().cast("array<struct<k:int,e:double>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["k"].alias("k"), F.when(F.size(acc) == 0, x["v"]).otherwise(x["v"] * alpha + F.element_at(acc, -1)["e"] * (1 - alpha)).alias("e")
        ))),
    )
    return ticks.select(*by, F.explode(fold).alias("r")).select(*by, F.col("r.k").alias(order), F.col("r.e").alias("ema"))
