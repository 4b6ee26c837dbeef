"""Two-phase fits of many groups at once: expectation-maximisation over each group's counted values.

A group is a frame or a capture, so its counted values are at most a capture's cells. No step of a fit is a job of its own;
it is taken in numpy for the groups of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEPS = 64
FLOOR = 1e-9  # of a fit's deviation

# Half of log(2 pi).
HALF_LOG_2PI = 0.9189385332046727


def counted(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, vs): the number of values, and the distinct ones in order with their counts."""
    per = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("s")).agg(F.count("*").cast("double").alias("c"))
    return per.groupBy(*by).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("s", "c"))).alias("vs"))


def _let(value: str, name: str, body: str) -> str:
    """body, in which name stands for value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _folded(n: np.ndarray, s: np.ndarray, c: np.ndarray, steps: int) -> list[np.ndarray]:
    """mf, mb, pb and sd of many groups after so many steps: s and c are (values, groups), with counts of 0 where a group has
    fewer values."""
    half = np.floor(n / 2)
    total, take = (c * s).sum(0), np.minimum(c, np.maximum(0.0, half - (np.cumsum(c, 0) - c)))
    lo = (take * s).sum(0)
    mf, mb, pb = (total - lo) / (n - half), lo / np.maximum(1.0, half), np.full(len(n), 0.5)
    off = s - total / n
    sd = np.maximum(FLOOR, np.sqrt((c * off * off).sum(0) / n))
    for _ in range(steps):
        front, back = s - mf, s - mb
        r = 1 / (1 + np.exp(-(np.log(pb / (1 - pb)) + (front * front - back * back) / (2 * sd * sd))))
        b, bx, fx = (c * r).sum(0), (c * r * s).sum(0), (c * (1 - r) * s).sum(0)
        both = (b > 0) & (b < n)
        mf, mb, pb = np.where(both, fx / (n - b), mf), np.where(both, bx / b, mb), np.where(both, b / n, pb)
        front, back = s - mf, s - mb
        var = (c * (r * back * back + (1 - r) * front * front)).sum(0)
        sd = np.where(both, np.maximum(FLOOR, np.sqrt(np.maximum(0.0, var / n))), sd)
    turned = mf < mb
    return [np.where(turned, mb, mf), np.where(turned, mf, mb), np.where(turned, 1 - pb, pb), sd]


def fit(groups: DataFrame, steps: int = STEPS, most: int = 1 << 18) -> DataFrame:
    """groups(n, vs, ...) with fit, a struct of mf, mb, pb and sd: front and back mean, back weight and common deviation.

    The fit begins with the means of the lower and the upper half of the values. Groups of fewer than two values have no fit;
    a group whose phases run empty keeps the last fit that both had. In the end the front mean is not below the back one.
    Steps are taken for many groups at once, of at most so many values together unless one alone has more.
    """
    kinds = T.StructType([T.StructField(k, T.DoubleType()) for k in ("mf", "mb", "pb", "sd")])
    schema = T.StructType([*groups.schema.fields, T.StructField("fit", kinds)])
    at_n, at_vs = groups.columns.index("n"), groups.columns.index("vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.column(at_n).to_numpy(), batch.column(at_vs)
            size, flat = np.asarray(lists.value_lengths()), lists.flatten()
            value, count = (flat.field(k).to_numpy() for k in ("s", "c"))
            first = np.cumsum(size) - size
            found = np.full((4, len(n)), np.nan)
            order = np.argsort(size, kind="stable")  # groups of like size share an array
            low = 0
            with np.errstate(all="ignore"):
                while low < len(order):
                    high = low + 1
                    while high < len(order) and (high + 1 - low) * size[order[high]] <= most:
                        high += 1
                    own = order[low:high]
                    place = np.arange(size[own[-1]])[:, None]
                    there = place < size[own]
                    at = np.where(there, first[own] + place, 0)
                    found[:, own] = _folded(n[own], np.where(there, value[at], 0.0), np.where(there, count[at], 0.0), steps)
                    low = high
            fitted = pa.StructArray.from_arrays([pa.array(v) for v in found], kinds.names, mask=pa.array(n < 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, fitted], schema.names)

    return groups.mapInArrow(run, schema)


def log_likelihood(fit: str) -> Column:
    """Of a group's values vs under a fit."""
    part = lambda weight, mean: f"(ln({weight}) - (x.s - {fit}.{mean}) * (x.s - {fit}.{mean}) / (2 * {fit}.sd * {fit}.sd) - ln({fit}.sd) - {HALF_LOG_2PI}D)"
    both = _let(f"named_struct('b', {part(f'{fit}.pb', 'mb')}, 'f', {part(f'1 - {fit}.pb', 'mf')})", "l", "greatest(l.b, l.f) + ln(exp(l.b - greatest(l.b, l.f)) + exp(l.f - greatest(l.b, l.f)))")
    return F.expr(f"aggregate(vs, 0D, (z, x) -> z + x.c * {both})")


def verdict(fitted: DataFrame) -> DataFrame:
    """fitted(n, vs, fit, ...) with bic_one and bic_two, of one phase and of the fit, and two_phase: the fit wins and its
    front lies above its back."""
    mean = "aggregate(vs, 0D, (z, x) -> z + x.c * x.s) / n"
    single = fitted.withColumn("_m", F.expr(mean))
    single = single.withColumn("_one", F.expr(f"named_struct('mf', _m, 'mb', _m, 'pb', 0.5D, 'sd', greatest({FLOOR}D, sqrt(aggregate(vs, 0D, (z, x) -> z + x.c * (x.s - _m) * (x.s - _m)) / n)))"))
    bic = single.withColumn("bic_one", F.ln("n") * 2 - log_likelihood("_one") * 2).withColumn("bic_two", F.ln("n") * 4 - log_likelihood("fit") * 2)
    wins = F.coalesce((F.col("fit.mf") > F.col("fit.mb")) & (F.col("bic_two") < F.col("bic_one")), F.lit(False))
    return bic.withColumn("two_phase", wins).drop("_m", "_one")


def temperature(fit: str = "fit") -> Column:
    """Null where the phases coincide."""
    return F.try_divide(F.col(f"{fit}.sd") * F.col(f"{fit}.sd"), F.nullif(F.col(f"{fit}.mf") - F.col(f"{fit}.mb"), F.lit(0.0)))


def degenerate(fit: str = "fit") -> Column:
    return ~F.coalesce((F.col(f"{fit}.mf") > F.col(f"{fit}.mb")) & (temperature(fit) < float("inf")), F.lit(False))


def crossover(fit: str = "fit") -> Column:
    return (F.col(f"{fit}.mf") + F.col(f"{fit}.mb")) / 2 + temperature(fit) * F.ln(F.col(f"{fit}.pb") / (1 - F.col(f"{fit}.pb")))


def pull(s: Column, fit: str = "fit") -> Column:
    """Posterior of the back phase at s; 0 under a degenerate fit."""
    return F.when(degenerate(fit), 0.0).otherwise(1 / (1 + F.exp((s - crossover(fit)) / temperature(fit))))


def coverage(s: Column, fit: str = "fit", two_phase: Column | None = None, bleed: bool = True) -> Column:
    """The back phase's share of a cell: its posterior, or 0 or 1 without bleed; 0 where there is one phase only."""
    t = pull(s, fit) if bleed else F.when(degenerate(fit) | (pull(s, fit) < 0.5), 0.0).otherwise(1.0)
    return t if two_phase is None else F.when(two_phase, t).otherwise(0.0)


def lifted(within: Column, fit: str = "fit") -> Column:
    """The fit of block means, widened by the variance within blocks."""
    sd = F.greatest(F.lit(FLOOR), F.sqrt(F.col(f"{fit}.sd") * F.col(f"{fit}.sd") + F.greatest(F.lit(0.0), within)))
    return F.col(fit).withField("sd", sd)


def gain(series: DataFrame, by: list[str], order: str, vector: str) -> DataFrame:
    """(by, gain): the steady gain of a local level under each group's sequence of vectors, from the lag-1 autocorrelation of
    their steps, pooled over components.

    1 for fewer than three vectors or where no component moves or shows noise; 0 where none drifts.
    """
    parts = series.where(F.col(vector).isNotNull()).select(*by, order, F.posexplode(vector).alias("k", "v"))
    own = Window.partitionBy(*by, "k")
    ticks = parts.withColumn("m", F.count("*").over(own)).where("m >= 3")
    d = ticks.withColumn("d", F.col("v") - F.lag("v").over(own.orderBy(order))).where("d is not null")
    e = d.withColumn("e", F.col("d") - F.avg("d").over(own)).withColumn("f", F.lead("e").over(own.orderBy(order)))
    energy = F.avg(F.col("e") * F.col("e"))
    rho = F.try_divide(F.sum(F.col("e") * F.col("f")), (F.count("*") - 1) * energy)
    r = e.groupBy(*by, "k").agg(F.when(energy > 0, rho).alias("rho")).where("rho is not null")
    zero = F.lit(0.0)
    sums = r.groupBy(*by).agg(F.sum(F.greatest(zero, -F.col("rho"))).alias("noise"), F.sum(F.greatest(zero, 1 + F.least(zero, F.col("rho")) * 2)).alias("drift"))
    ratio = F.try_divide("drift", "noise")
    x = (ratio + F.sqrt(ratio * ratio + ratio * 4)) / 2
    found = F.when(F.col("noise") == 0, 1.0).when(F.col("drift") == 0, 0.0).otherwise(x / (x + 1))
    return series.select(*by).distinct().join(sums.select(*by, found.alias("gain")), by, "left").select(*by, F.coalesce("gain", F.lit(1.0)).alias("gain"))


def smoothed(series: DataFrame, by: list[str], order: str, vector: str, gains: DataFrame) -> DataFrame:
    """(by, order, vector): e_0 = v_0, e_t = e_{t-1} + gain (v_t - e_{t-1}) for every group, component by component; a null
    vector leaves the state as it is. A group is as short as a capture."""
    rows = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(vector).alias("v")))).alias("a"))
    kind = dict(series.dtypes)[order]
    last = "z[size(z) - 1].v"
    now = f"if(size(z) = 0, x.v, if(x.v is null, {last}, if({last} is null, x.v, zip_with({last}, x.v, (u, w) -> u + gain * (w - u)))))"
    fold = f"aggregate(a, cast(array() as array<struct<k:{kind},v:array<double>>>), (z, x) -> concat(z, array(named_struct('k', x.k, 'v', {now}))))"
    return rows.join(gains, by).select(*by, F.explode(F.expr(fold)).alias("r")).select(*by, F.col("r.k").alias(order), F.col("r.v").alias(vector))


def state(fit: str = "fit") -> Column:
    """A fit as the vector that is smoothed: both means, the weight's logit and the deviation's logarithm."""
    f = lambda c: F.col(f"{fit}.{c}")
    return F.when(F.col(fit).isNotNull(), F.array(f("mf"), f("mb"), F.ln(f("pb") / (1 - f("pb"))), F.ln(f("sd"))))


def from_state(vector: str) -> Column:
    v = F.col(vector)
    return F.when(v.isNotNull(), F.struct(v[0].alias("mf"), v[1].alias("mb"), (1 / (1 + F.exp(-v[2]))).alias("pb"), F.exp(v[3]).alias("sd")))


def filtered(fits: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, order, fit, gain) of fits(by, order, fit): each group's fits as a filtered sequence."""
    states = fits.select(*by, order, state().alias("v"))
    gains = gain(states, by, order, "v")
    return smoothed(states, by, order, "v", gains).join(gains, by).select(*by, order, from_state("v").alias("fit"), "gain")
